"""Reading and writing of runs, curves and exports."""
