"""Personal data: exact pattern rules, and a linear-chain CRF over word shapes that adds secrets to their spans.

The CRF is trained from a small labelled table and decoded by Viterbi in numpy over all words of a batch at once.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cosmotab.llm.common import map_texts, utf8_view

KINDS = ("email", "ip", "card", "phone")
ADDED = "secret"
STATES = ("o", "contact", ADDED)
#: Bound of the fit: rows of the labelled table that are read at most.
FIT_ROWS = 2000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: around each @ the longest local part after the last match, then a domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        at = text.find("@", max(free, at + 1))
    return out


def rule_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all base spans, by start, then kind as listed. Each rule takes time linear in the text."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) < 4 and int(p or "0") <= 255 for x in m.groups()):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- word shapes -----------------------------------------------------------------------------------------------------

#: Bits of a word's shape: the classes of its bytes.
_BITS = {"lower": 1, "upper": 2, "digit": 4, "wide": 8, "at": 16, "equals": 32, "dash": 64, "quote": 128, "slash": 256, "paren": 512, "plus": 1024, "other": 2048}
_CLASS = np.full(256, _BITS["other"], np.int32)
for _chars, _name in ((range(97, 123), "lower"), (range(65, 91), "upper"), (range(48, 58), "digit"), (range(128, 256), "wide"), (b"@", "at"), (b"=", "equals"), (b"-_", "dash"), (b"\"'`", "quote"), (b"/:", "slash"), (b"()", "paren"), (b"+", "plus")):
    _CLASS[list(_chars)] = _BITS[_name]
_CLASS[list(b".,;!?|")] = 0
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_N_BITS = 12
_LENGTHS = np.array([4, 8, 12, 16, 24])  # word lengths where the next length feature begins
_TURNS = np.array([1, 2, 4])  # changes between letters and digits where the next feature begins
_AFTER_EQUALS = 1 << 18
_LOWER_RUNS, _DIGIT_RUNS = np.array([6, 7]), np.array([9, 12])  # longest runs in a word where the next feature begins
_LOWER_AT, _DIGIT_AT, _INNER_DOT, _CUE_AT = 19, 21, 1 << 23, 24
#: What the name or the word before a long mixed word may end in: names of credentials, and of things that have numbers.
CREDENTIALS = ("password", "passwd", "passwort", "pwd", "secret", "token", "key", "bearer", "auth", "credential", "credentials", "jeton", "clave", "schlüssel")
REFERENCES = (
    "commit", "sha", "hash", "checksum", "digest", "build", "version", "release", "order", "invoice", "ticket", "file", "image", "photo", "gene", "chromosome", "model", "serial", "part", "item",
    "id", "uuid", "guid", "request", "tracking", "iban", "reference", "ref", "function", "class", "method", "revision", "etag", "bestellung", "datei", "commande", "fichier", "pedido", "archivo",
)
_LETTERS_ONLY = re.compile(r"[^\W\d_]+")


def words_and_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts; start and end of each word (between ASCII white space); the words' shape codes."""
    data, at = utf8_view(texts)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, at, none, none, none
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    if not len(starts):
        return data, at, starts, ends, starts
    classes = _CLASS[data]
    code = np.bitwise_or.reduceat(classes, starts)
    letter, digit = (classes & 3) > 0, (classes & 4) > 0
    turn = np.zeros(len(data) + 1, np.int64)
    turn[2:] = np.cumsum((letter[:-1] & digit[1:]) | (digit[:-1] & letter[1:]))
    turns = turn[ends] - turn[np.minimum(starts + 1, ends)]
    code |= np.searchsorted(_LENGTHS, ends - starts, side="right").astype(np.int32) << _N_BITS
    code |= np.searchsorted(_TURNS, turns, side="right").astype(np.int32) << (_N_BITS + 3)
    text = np.searchsorted(at, starts, side="right")
    before = np.zeros(len(code), bool)
    before[1:] = ((code[:-1] & _BITS["equals"]) > 0) & (text[1:] == text[:-1])
    code |= np.where(before, _AFTER_EQUALS, 0)
    place, first = np.arange(len(data)), np.zeros(len(data), np.int64)
    first[starts] = starts + 1
    first = np.maximum.accumulate(first) - 1  # where the word of each byte begins
    for kind, edges, shift in ((_BITS["lower"], _LOWER_RUNS, _LOWER_AT), (_BITS["digit"], _DIGIT_RUNS, _DIGIT_AT)):
        run = place - np.maximum(np.maximum.accumulate(np.where(classes & kind, -1, place)), first - 1)
        code |= np.searchsorted(edges, np.maximum.reduceat(run, starts), side="right").astype(np.int32) << shift
    dots = np.concatenate([[0], np.cumsum(data == 46)])
    code |= np.where(dots[ends - 1] > dots[starts], _INNER_DOT, 0)
    mixed = np.flatnonzero(((code & _BITS["digit"]) > 0) & ((code & 3) > 0) & (ends - starts >= 12))
    raw = data.tobytes() if len(mixed) else b""
    for i in mixed.tolist():
        code[i] |= cue(raw, starts, ends, text, i) << _CUE_AT
    return data, at, starts, ends, code


def cue(raw: bytes, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, i: int) -> int:
    """What the name before a word's equals sign, else the next of three words before it that has letters, says it is: 0
    nothing, 1 a credential, 2 a reference."""
    name, _, rest = raw[starts[i] : ends[i]].rpartition(b"=")
    given = [name] if rest else []
    given += [raw[starts[j] : ends[j]] for j in range(i - 1, max(-1, i - 4), -1) if text[j] == text[i]]
    for word in given:
        if letters := "".join(_LETTERS_ONLY.findall(word[-64:].decode("utf-8", "ignore").lower())):
            return 1 if letters.endswith(CREDENTIALS) else 2 if letters.endswith(REFERENCES) else 0
    return 0


def features(codes: np.ndarray) -> np.ndarray:
    """A 0/1 row for each code: its bits, its length and its turns one-hot, and a few pairs of these."""
    bits = (codes[:, None] >> np.arange(_N_BITS)) & 1
    length = ((codes >> _N_BITS) & 7)[:, None] == np.arange(len(_LENGTHS) + 1)
    turns = ((codes >> (_N_BITS + 3)) & 3)[:, None] == np.arange(len(_TURNS) + 1)
    after = (codes & _AFTER_EQUALS)[:, None] > 0
    mixed = (bits[:, 2:3] > 0) & ((bits[:, 0:1] | bits[:, 1:2]) > 0)
    pure = bits[:, 2:3] * (1 - bits[:, 0:1]) * (1 - bits[:, 1:2])
    one_of = lambda shift, n: ((codes >> shift) & 3)[:, None] == np.arange(n)
    context = np.hstack([one_of(_LOWER_AT, 3), one_of(_DIGIT_AT, 3), (codes & _INNER_DOT)[:, None] > 0, one_of(_CUE_AT, 3)])
    return np.hstack([bits, length, turns, after, mixed & length, mixed & turns, pure * length, context, mixed & context, np.ones((len(codes), 1))]).astype(float)


# --- the conditional random field ------------------------------------------------------------------------------------


@dataclass
class Model:
    """emission[f, s], move[s, t] between states, begin[s] and finish[s] at the ends of a text."""

    emission: np.ndarray
    move: np.ndarray
    begin: np.ndarray
    finish: np.ndarray


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Maximum penalised likelihood by Adam, from (codes, states) of each training text; padded forward-backward."""
    sequences = [(c, s) for c, s in sequences if len(c)]
    n, k = max((len(c) for c, _ in sequences), default=1), len(STATES)
    width = features(np.zeros(1, np.int64)).shape[1]
    x, y, mask = np.zeros((len(sequences), n, width)), np.zeros((len(sequences), n), np.int64), np.zeros((len(sequences), n), bool)
    for i, (codes, states) in enumerate(sequences):
        x[i, : len(codes)], y[i, : len(codes)], mask[i, : len(codes)] = features(codes), states, True
    m = Model(np.zeros((width, k)), np.zeros((k, k)), np.zeros(k), np.zeros(k))
    if not len(sequences):
        return m
    last = mask.sum(axis=1) - 1
    rows = np.arange(len(sequences))
    gold = np.eye(k)[y] * mask[..., None]
    pairs = (mask[:, 1:] & mask[:, :-1])[..., None, None]
    gold_move = (gold[:, :-1, :, None] * gold[:, 1:, None, :] * pairs).sum(axis=(0, 1))
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in (m.emission, m.move, m.begin, m.finish)]
    for step in range(1, steps + 1):
        e = x @ m.emission
        up, down = np.zeros_like(e), np.zeros_like(e)
        up[:, 0] = m.begin + e[:, 0]
        for t in range(1, n):
            up[:, t] = np.where(mask[:, t, None], _log_sum(up[:, t - 1, :, None] + m.move, 1) + e[:, t], up[:, t - 1])
        whole = _log_sum(up[rows, last] + m.finish, 1)
        down[:, n - 1] = m.finish
        for t in range(n - 2, -1, -1):
            down[:, t] = np.where(mask[:, t + 1, None], _log_sum(m.move + (e[:, t + 1] + down[:, t + 1])[:, None, :], 2), m.finish)
        here = np.exp(up + down - whole[:, None, None]) * mask[..., None]
        both = np.exp(up[:, :-1, :, None] + m.move + (e[:, 1:] + down[:, 1:])[:, :, None, :] - whole[:, None, None, None]) * pairs
        grads = [
            np.einsum("ntf,nts->fs", x, gold - here),
            gold_move - both.sum(axis=(0, 1)),
            (gold[:, 0] - here[:, 0]).sum(axis=0),
            (gold[rows, last] - here[rows, last]).sum(axis=0),
        ]
        for p, g, (a, b) in zip((m.emission, m.move, m.begin, m.finish), grads, moment, strict=True):
            g = g / len(sequences) - decay * p
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return m


class Decoder:
    """Viterbi over all words of a batch.

    A word is plain if, whatever its neighbours' states, state o is at least as good for it as any other: then some best
    path has o there (o also wins ties), and the chain falls apart at it. Only the short stretches of other words are
    decoded, all of them side by side, one numpy step for each position.
    """

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[int, tuple[np.ndarray, bool]] = {}
        into = np.vstack([model.move, model.begin])  # from each state, or at the beginning
        out = np.hstack([model.move, model.finish[:, None]])  # to each state, or at the end
        self.margin = np.array([(into[:, 0] - into[:, s]).min() + (out[0] - out[s]).min() for s in range(len(STATES))])

    def decode(self, codes: np.ndarray, text: np.ndarray) -> np.ndarray:
        """States of words with these codes in these texts (equal numbers: one text)."""
        states = np.zeros(len(codes), np.int8)
        own, code = np.unique(codes, return_inverse=True)
        new = np.array([c for c in own.tolist() if c not in self.known], np.int64)
        for c, score in zip(new.tolist(), features(new) @ self.model.emission, strict=True):
            self.known[c] = score, bool((score[0] + self.margin[1:] >= score[1:]).all())
        scores = np.array([self.known[c][0] for c in own.tolist()]).reshape(-1, len(STATES))
        at = np.flatnonzero(~np.array([self.known[c][1] for c in own.tolist()], bool)[code])
        if not len(at):
            return states
        joined = np.concatenate([[False], (np.diff(at) == 1) & (text[at[1:]] == text[at[:-1]])])
        begin = np.flatnonzero(~joined)
        size = np.diff(np.append(begin, len(at)))
        by = np.argsort(-size, kind="stable")
        begin, size = begin[by], size[by]
        head = at[begin]
        opens = np.where((head == 0) | (text[np.maximum(head - 1, 0)] != text[head]), True, False)
        score = np.where(opens[:, None], self.model.begin, self.model.move[0]) + scores[code[head]]
        links = []
        for t in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -t, side="left"))  # stretches longer than t
            paths = score[:live, :, None] + self.model.move
            links.append(paths.argmax(axis=1))
            score[:live] = paths.max(axis=1) + scores[code[at[begin[:live] + t]]]
        tail = at[begin + size - 1]
        closes = (tail == len(codes) - 1) | (text[np.minimum(tail + 1, len(codes) - 1)] != text[tail])
        state = (score + np.where(closes[:, None], self.model.finish, self.model.move[:, 0])).argmax(axis=1)
        for t in range(int(size[0]) - 1, -1, -1):
            live = int(np.searchsorted(-size, -t, side="left"))
            states[at[begin[:live] + t]] = state[:live]
            if t:
                state[:live] = links[t - 1][np.arange(live), state[:live]]
        return states


def core(word: str) -> tuple[int, int]:
    """Where the secret itself is in a word: after the last inner equals sign, from its first letter or digit to its last."""
    b = len(word)
    while b and not word[b - 1].isalnum():
        b -= 1
    a = word.rfind("=", 0, b) + 1
    while a < b and not word[a].isalnum():
        a += 1
    return a, b


def apart_from(base: list[tuple[int, int, str]], more: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans of `more` that meet no span of `base` (ordered by start): each looks up the furthest end before its own."""
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
    out = []
    for span in more:
        k = bisect_left(starts, span[1])
        if not k or ends[k - 1] <= span[0]:
            out.append(span)
    return out


def added_spans(texts: pa.Array, decoder: Decoder) -> list[list[tuple[int, int, str]]]:
    """For each text the secrets that the field finds, as code points."""
    data, at, starts, ends, codes = words_and_codes(texts)
    text = np.searchsorted(at, starts, side="right") - 1
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(texts))]
    raw = data.tobytes() if len(data) else b""
    where: dict[int, tuple[int, int]] = {}  # of each text: bytes counted so far, and their code points
    for i in np.flatnonzero(decoder.decode(codes, text) == STATES.index(ADDED)):
        n = int(text[i])
        byte, point = where.get(n, (int(at[n]), 0))
        point += len(raw[byte : starts[i]].decode())
        where[n] = int(starts[i]), point
        a, b = core(raw[starts[i] : ends[i]].decode())
        if b > a:
            out[n].append((point + a, point + b, ADDED))
    return out


def labelled_sequence(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and states of a training text: words that meet a labelled span are secrets, those that meet a base span
    contacts."""
    _, _, starts, ends, codes = words_and_codes(pa.array([text]))
    raw, states = text.encode(), np.zeros(len(codes), np.int64)
    for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
        a, b = len(raw[:s].decode()), len(raw[:e].decode())
        for kind, found in ((1, [x[:2] for x in rule_spans(text)]), (2, spans)):
            if any(x < b and a < y for x, y in found):
                states[i] = kind
    return codes, states


def fit(table: DataFrame, *, text_col: str = "text", spans_col: str = "spans", fit_rows: int = FIT_ROWS) -> Model:
    """A field trained from a labelled table: texts, and arrays of (start, end) of their secrets; fit_rows rows at most."""
    rows = table.select(text_col, spans_col).filter(table[text_col].isNotNull()).limit(fit_rows).collect()
    return train([labelled_sequence(r[0], [(x[0], x[1]) for x in r[1] or []]) for r in rows])


def find(docs: DataFrame, model: Model, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """For each row of docs: struct `row` of the carried columns (all if None), base and spans (arrays of kind, start, end).

    base holds the spans of the rules; spans those and the secrets of the field that meet none of them, by start, then
    kind as listed (secrets last). Positions are code points of the whole text, end exclusive. Null and empty texts have
    none; texts of any length are searched whole, in time linear in it; repeated rows one by one; where rules tie, each
    kind keeps its own spans; an empty table gives an empty result; carried columns of any name stay apart in the struct.
    A secret is a word that looks like one: by its shape, its runs of letters and digits, and the name or word before it
    (a hash after `commit` is none, a bare one can't be told from a key of that form); identifiers with dashes, names in
    code, file names and addresses with such a path are none. A narrow map: no shuffle; the model (some KB)
    is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        decoder = Decoder(held.value)

        def work(texts: pa.Array) -> list:
            base = [rule_spans(t) for t in texts.to_pylist()]
            spans = [
                sorted(b + apart_from(b, more), key=lambda s: (s[0], (*KINDS, ADDED).index(s[2])))
                for b, more in zip(base, added_spans(texts, decoder), strict=True)
            ]
            return [[[{"kind": k, "start": a, "end": b} for a, b, k in row] for row in rows] for rows in (base, spans)]

        return work

    span = "array<struct<kind: string, start: int, end: int>>"
    return map_texts(docs, text_col, make, f"base {span}, spans {span}", carry, budget=2 << 20)


#: The small labelled table's sentences: {x} is a secret of 16 to 40 letters and digits in one of the usual alphabets,
#: {p} a base kind, {w} plain words, {g} an identifier with dashes, {l} an address with a hexadecimal path, {n} {u} {d} {c} numbers,
#: addresses, dates and short codes, {k} {r} a credential's or a reference's name, {h} a hash, {i} {f} {v} names in code, files and
#: builds, {o} long numbers with letters before. What stands for {x} is what is labelled.
TEMPLATES = (
    "{w} password={x} {w}", "{w} token = \"{x}\" {w}", "{w} {x} {w}", "{w} key: {x}, {w}", "{w} ist password={x} {w}", "api_key={x}",
    "{w} secret {x}. {w}", "{w} {p} {w} {x} {w}", "{w}", "{w} {w}", "{w} {p} {w}", "{p} {w} {p}", "{w} {n} {w}", "{w} {u} {w}", "{w} {d} {w} {n}", "{w} {c} {w}", "{n} {n} {n}",
    "{w} {g} {w}", "{w} id={g} {w}", "{w} {l} {w}", "{w} {x}### {w}", "{w} {l}, {w} {x} {w}",
    "{w} {k} {x} {w}", "{k}={x}", "{k}: {x}", "{x}", "{w} {r} {h} {w}", "{r} {h}", "{r}={h} {w}", "{w} {i} {w}", "{i}", "{w} {f} {w}", "{f}", "{w} {v} {w}", "{v}", "{w} {o} {w}", "{r} {o}", "{o}",
    "id={g}", "{g}", "{w} {r} {g}", "{w} {i}, {w} {x} {w}", "{w} {f} {w} {k} {x}", "{r} {i} {w}",
)


def labelled_rows(n: int = 800, seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """The small labelled table: n texts made from TEMPLATES by a seeded rule, with the spans of their secrets."""
    rng = np.random.default_rng(seed)
    syllables = ["the", "er", "ung", "que", "ción", "eau", "st", "of", "and", "ó", "ä", "les", "tion", "ich"]
    pick = lambda letters, k: "".join(letters[i] for i in rng.integers(0, len(letters), k))
    lower, upper, digits, hexes = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"

    def word() -> str:
        w = "".join(syllables[i] for i in rng.integers(0, len(syllables), rng.integers(1, 6)))
        w = w.upper() if rng.random() < 0.1 else w.capitalize() if rng.random() < 0.15 else w
        return w + [",", ".", "", "!!", "", "", ""][rng.integers(7)]

    def secret() -> str:
        while True:
            kind, k = rng.integers(3), int(rng.integers(16, 41))
            made = "AKIA" + pick(upper + digits, 16) if kind == 0 else pick(hexes, k) if kind == 1 else pick(lower + upper + digits, k)
            if sum(c.isdigit() for c in made) > 1 and sum(c.isalpha() for c in made) > 1:
                return made

    def contact() -> str:
        kind = rng.integers(4)
        if kind == 0:
            return f"{pick(lower, 5)}.{pick(digits, 2)}@mail{pick(digits, 1)}.example.com"
        if kind == 1:
            return ".".join(str(x) for x in rng.integers(1, 255, 4))
        return f"+1 ({pick(digits, 3)}) 555-{pick(digits, 4)}" if kind == 2 else "4" + pick(digits, 15)

    fill = {
        "w": lambda: " ".join(word() for _ in range(rng.integers(1, 9))),
        "p": contact,
        "n": lambda: pick(digits, int(rng.integers(1, 13))),
        "u": lambda: f"http://{pick(lower, 8)}.example.net/{pick(lower, 2)}/{pick(digits, 5)}",
        "d": lambda: f"20{pick(digits, 2)}-0{pick('123456789', 1)}-1{pick(digits, 1)}",
        "c": lambda: f"{pick(lower, 6)}{pick(digits, 1)}",
        "g": lambda: "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)),
        "l": lambda: f"https://{pick(lower, 7)}.example.com/{pick(hexes, int(rng.integers(12, 41)))}{['', '/', '.html', '/x'][rng.integers(4)]}",
    }
    stems = ["handle", "response", "render", "vaccine", "sample", "preview", "config", "parse", "session", "turbo", "protein", "thread", "upload", "screen", "report", "backup"]
    stem = lambda: stems[rng.integers(len(stems))]
    number = lambda: ["", "2", "V2", "42", "19", "2024", "20231104", pick(digits, 3), pick(upper, 3) + pick(digits, 3)][rng.integers(9)]
    identifier = lambda: "".join([stem(), number(), stem().capitalize() if rng.random() < 0.6 else stem(), pick(upper, 3) if rng.random() < 0.3 else "", number(), stem().capitalize(), pick(digits, 2)])
    fill |= {
        "k": lambda: CREDENTIALS[rng.integers(len(CREDENTIALS))],
        "r": lambda: REFERENCES[rng.integers(len(REFERENCES))],
        "h": lambda: pick(hexes, [16, 20, 32, 40][rng.integers(4)]),
        "i": identifier,
        "f": lambda: [f"IMG{pick(digits, 14)}", f"{stem()}_{pick(digits, 8)}_{stem()}", f"{stem()}{pick(digits, 14)}{pick(upper, 3)}", identifier()][rng.integers(4)] + [".jpg", ".tar.gz", ".csv", ".png", ".log"][rng.integers(5)],
        "v": lambda: f"{['v', 'build-', ''][rng.integers(3)]}{pick(digits, 1)}.{pick(digits, 1)}.{pick(digits, 2)}-{stem()}{pick(digits, 1)}-build{pick(digits, 8)}{pick(lower, 3)}",
        "o": lambda: pick(upper, int(rng.integers(2, 5))) + ["", "-"][rng.integers(2)] + pick(digits, int(rng.integers(14, 21))),
    }
    rows = []
    for _ in range(n):
        text, spans = "", []
        for part in re.split(r"(\{\w\})", TEMPLATES[rng.integers(len(TEMPLATES))]):
            if part == "{x}":
                made = secret()
                spans.append((len(text), len(text) + len(made)))
            else:
                made = fill[part[1]]() if part[:1] == "{" else part
            text += made
        rows.append((text, spans))
    return rows
