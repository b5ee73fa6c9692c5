"""Secret scans: fixed patterns, and a linear-chain CRF for what they miss.

The CRF tags the tokens of a text as begin, inside or outside of a secret from
their shape, the words beside them and features of the whole file, and decodes
by Viterbi. Every run of secret-like characters is tagged, short ones and ones
without a digit too. What stands between runs can only be outside (a structural
zero of the model), so decoding each run between outside tokens gives the best
path of the whole text.

Most words need no decoding of their own: with the largest weights that their
letters and any place without a hint before it (or any place at all) could add,
their best path is still outside. Such bounds are kept by form, a word with its
letters and digits replaced by their classes; the other words are decoded where
they stand, and runs with the same features share one decoding.

The model is trained here, by stochastic gradient ascent on the exact
likelihood, on generated lines of code, configuration and prose; it depends on
nothing but its seed, so every run tags alike.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only_cache, prepare, table, text_slices

SEED, TRAIN_LINES, EPOCHS, RATE, PENALTY = 7, 3000, 4, 0.3, 1e-4
KINDS = ("assign", "access", "hex", "crf")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
_FORBIDDEN = -1e9

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a leftmost match is a whole run of that length or more
_RUN = re.compile(r"[A-Za-z0-9+/_.=~-]+")
_LEFT, _RIGHT = 48, 24
_TOKEN = re.compile(r"[A-Za-z0-9]+|.")
_WORD = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")
_NEXT = re.compile(r"[^\S\n]*([A-Za-z0-9_]+|[^\sA-Za-z0-9_])")
#: Tokens of a long run that are scored at a time.
BLOCK = 512
#: Forms, runs and decodings a worker remembers; runs of more characters are not kept.
CACHE_RUNS, CACHE_CHARS = 200_000, 64
#: Words whose presence beside a token matters, as fixed values.
HINTS = frozenset("auth authorization bearer basic key keys apikey token tokens secret secrets password passwd pass pwd credential credentials access private client session cookie sig signature".split())
_PARTS = ("key", "token", "secret", "passw")
#: One of these stands in every word that is a hint.
_STEMS = ("auth", "bearer", "basic", "key", "token", "secret", "pass", "pwd", "credential", "access", "private", "client", "session", "cookie", "sig")


def base_spans(text: str, low: str | None = None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower() if low is None else low
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def secret_runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of secret-like characters."""
    for m in _RUN.finditer(text):
        yield m.span()


_CLASSES = str.maketrans(string.ascii_uppercase + string.ascii_lowercase + string.digits, "A" * 26 + "a" * 26 + "0" * 10)
_BYTE_CLASSES = bytes.maketrans((string.ascii_letters + string.digits).encode(), b"a" * 26 + b"A" * 26 + b"0" * 10)
_BYTE_RUN = re.compile(rb"[A-Za-z0-9+/_.=~-]+")
LOUD, CALM, DULL = 0, 1, 2
_HINT_SIZES = frozenset(map(len, HINTS))
_RUN_SIGNS = frozenset("Aa0+/_.=~-")
_SAME = re.compile(r"(.)\1+", re.DOTALL)


def _shape(token: str) -> str:
    return _SAME.sub(r"\1", token.translate(_CLASSES))[:6]


@functools.lru_cache(CACHE_RUNS)
def _bits(counts: tuple[int, ...]) -> int:
    n = sum(counts)
    return round(-2 * sum(k / n * math.log2(k / n) for k in counts))


def _counts(token: str) -> tuple[int, ...]:
    return tuple(sorted(map(token.count, set(token))))


def _mix(token: str) -> int:
    """Bits of character entropy, rounded to halves."""
    return _bits(_counts(token))


def file_features(text: str) -> tuple[str, ...]:
    n = max(1, len(text))
    code = sum(text.count(c) for c in "={};") * 200 // n
    return (f"file:code={min(code, 4)}", f"file:lines={min(text.count(chr(10)) * 100 // n, 4)}")


def run_tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Token spans of a run."""
    return [(start + m.start(), start + m.end()) for m in _TOKEN.finditer(text[start:end])]


@functools.lru_cache(CACHE_RUNS)
def _is_hint(word: str) -> bool:
    low = word.lower()
    return low in HINTS or any(h in low for h in _PARTS)


@functools.lru_cache(CACHE_RUNS)
def _shown(word: str) -> str:
    return word.lower() if word.lower() in HINTS else "w" if word[0] == "_" or word[0].isalnum() else word


def hint_zones(low: str) -> list[tuple[int, int]]:
    """Where runs may start that have a hint before them; ``low`` is the text in lower case."""
    found = []
    for stem in _STEMS:
        at = low.find(stem)
        while at >= 0:
            found.append(at)
            at = low.find(stem, at + 1)
    out: list[tuple[int, int]] = []
    for at in sorted(found):
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], at + _LEFT)
        else:
            out.append((at, at + _LEFT))
    return out


def context(text: str, start: int, end: int) -> tuple[bool, str, str, str]:
    """Whether a hint stands before a run, the last two words before it, and the sign after it."""
    left = _WORD.findall(text[max(0, start - _LEFT) : start].rsplit("\n", 1)[-1])[-4:]
    right = _NEXT.match(text, end, end + _RIGHT)
    after = "$" if right is None else "w" if right[1].isalnum() else right[1]
    return any(map(_is_hint, left)), _shown(left[-1]) if left else "^", _shown(left[-2]) if len(left) > 1 else "^", after


def run_features(whole: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Feature names that all tokens of a run share, and those of them told apart by a hint."""
    digits, shape = sum(c.isdigit() for c in whole) * 5 // len(whole), _shape(whole)
    alpha = any(c.isalpha() for c in whole)
    run = (
        f"run:len={min(len(whole) // 6, 8)}",
        f"run:mix={_mix(whole)}",
        f"run:digits={digits}",
        f"run:shapes={min(len(shape), 6)}",
        f"run:alpha={alpha}",
        f"run:both={any(c.isupper() for c in whole) and any(c.islower() for c in whole)}",
    )
    return run, (f"alpha={alpha}|digits={digits}", f"shape={shape}", f"len={min(len(whole) // 3, 9)}")


def token_features(tokens: list[str], first: bool = True, before: str = "^", after: str = "$") -> list[tuple[str, ...]]:
    """Feature names of each of a run's tokens; ``before`` and ``after`` are the shapes beside a block of them."""
    shapes = [before, *map(_shape, tokens), after]
    return [
        (f"len={min(len(t) // 4, 8)}", f"shape={shapes[k + 1]}", f"mix={_mix(t)}", f"first={first and k == 0}", f"known={t.lower() in HINTS}", f"prev={shapes[k]}", f"next={shapes[k + 2]}")
        for k, t in enumerate(tokens)
    ]


def own_features(whole: str, tokens: list[str]) -> tuple[tuple[str, ...], ...]:
    """Feature names that a run has wherever it stands: of the run, those told apart by a hint, and of each token."""
    return *run_features(whole), *token_features(tokens)


def kind_of(whole: str) -> tuple:
    """All that :func:`own_features` of a run depends on."""
    tokens = tuple([(len(t), _shape(t), _counts(t), t.lower() in HINTS) for t in _TOKEN.findall(whole)])
    plain = whole.islower() and whole.isalpha()
    rest = (0, True, False, True) if plain else (sum(c.isdigit() for c in whole), any(map(str.isalpha, whole)), any(map(str.isupper, whole)), any(map(str.islower, whole)))
    return _shape(whole), _counts(whole), rest, tokens


def named(own: tuple[tuple[str, ...], ...], at: tuple[bool, str, str, str], of_file: tuple[str, ...]) -> list[list[str]]:
    """Feature names of each token of a run at its place."""
    hint, last, before, after = at
    run = [*own[0], f"hint={hint}", *(f"hint={hint}|{x}" for x in own[1]), f"l1={last}", f"l2={before}", f"r1={after}", *of_file]
    return [run + list(x) for x in own[2:]]


def features(text: str, start: int, end: int, tokens: list[tuple[int, int]], of_file: tuple[str, ...]) -> list[list[str]]:
    """Feature names of each token of a run."""
    return named(own_features(text[start:end], [text[a:b] for a, b in tokens]), context(text, start, end), of_file)


class Model:
    """Weights of a linear-chain CRF: a row of three per feature, and the transitions."""

    def __init__(self) -> None:
        self.weights: dict[str, np.ndarray] = {}
        self.move = np.zeros((3, 3))
        self.move[OUTSIDE, INSIDE] = _FORBIDDEN
        self.forget()

    def forget(self) -> None:
        """Start over with what is remembered of runs."""
        self.kinds: dict[tuple, tuple] = {}
        self.names: dict[tuple, int] = {}
        self.paths: dict[tuple, list[int]] = {}
        #: By form: outside wherever it stands, wherever no hint stands before it, or neither is certain.
        self.levels: dict[bytes, int] = {}

    def scores(self, names: list[list[str]], first: bool = True) -> np.ndarray:
        zero = np.zeros(3)
        out = np.array([sum((self.weights.get(n, zero) for n in row), zero) for row in names])
        if first:
            out[0, INSIDE] = _FORBIDDEN  # what stands before a run is outside
        return out

    def decode(self, blocks: Iterator[list[list[str]]] | list[list[list[str]]]) -> list[int]:
        """The best path (Viterbi) of a run whose tokens come in blocks: scores go
        over from one to the next, and a token leaves three bytes behind."""
        best, back = None, bytearray()
        for names in blocks:
            for row in self.scores(names, best is None):
                if best is None:
                    best = row
                    continue
                reach = best[:, None] + self.move
                back += bytes(reach.argmax(0).tolist())
                best = reach.max(0) + row
        path = [int(best.argmax())]
        for i in range(len(back) - 3, -1, -3):
            path.append(back[i + path[-1]])
        return path[::-1]

    def _own(self, whole: str) -> tuple[int, tuple]:
        """A number for the features that a short run has anywhere, and these."""
        kind = kind_of(whole)
        if (known := self.kinds.get(kind)) is None:
            own = own_features(whole, _TOKEN.findall(whole))
            known = self.kinds[kind] = self.names.setdefault(own, len(self.names)), own
        return known

    def path(self, whole: str, at: tuple[bool, str, str, str], of_file: tuple[str, ...]) -> list[int]:
        """The best path of a short run, decoded once for each set of features."""
        number, own = self._own(whole)
        key = (number, at, of_file)
        if (found := self.paths.get(key)) is None:
            found = self.paths[key] = self.decode([named(own, at, of_file)])
        return found

    def _most(self, prefix: str, free: bool = True) -> np.ndarray:
        """The most that the features of a prefix add to a token's scores against outside."""
        seen = [w - w[OUTSIDE] for n, w in self.weights.items() if n.startswith(prefix) and (free or not _is_hint(n.removeprefix(prefix)))]
        return np.max([np.zeros(3), *seen], axis=0)

    @functools.cached_property
    def highest(self) -> tuple[np.ndarray, np.ndarray]:
        """The most that a place without a hint before it adds, and any place."""
        fixed = self._most("r1=") + self._most("file:code=") + self._most("file:lines=")
        return fixed + self._most("l1=", False) + self._most("l2=", False), fixed + self._most("l1=") + self._most("l2=")

    def _open(self, whole: str, tokens: list[str]) -> list[np.ndarray]:
        """The most that is added to each token by what a form leaves open: how mixed its letters are, and which word it is."""
        zero, against = np.zeros(3), lambda n: self.weights.get(n, np.zeros(3)) - self.weights.get(n, np.zeros(3))[OUTSIDE]
        mixes = lambda t: range(round(2 * math.log2(len(t))) + 1)
        known = lambda t: np.max([against("known=False"), against("known=True") if t.isalpha() and len(t) in _HINT_SIZES else against("known=False")], axis=0)
        if len(tokens) == 1:
            return [np.max([against(f"run:mix={x}") + against(f"mix={x}") for x in mixes(whole)], axis=0) + known(whole)]
        run = np.max([zero, *(against(f"run:mix={x}") for x in mixes(whole))], axis=0)
        return [run + np.max([against(f"mix={x}") for x in mixes(t)], axis=0) + known(t) for t in tokens]

    def _only_outside(self, own: tuple, hint: bool, open_: list[np.ndarray] | None = None) -> bool:
        """Whether every path with a begin scores less than all outside, whatever a run's place adds.

        ``open_``: ``own`` is of a form, which leaves some features open; the most that these add.
        """
        zero, run = np.zeros(3), [*own[0], f"hint={hint}", *(f"hint={hint}|{x}" for x in own[1])]
        left_out = ("run:mix=", "mix=", "known=") if open_ else ()
        told = lambda names: sum((self.weights.get(n, zero) for n in names if not n.startswith(left_out)), zero)
        shared = told(run) + self.highest[hint]
        rows = [shared + told(x) + (open_[i] if open_ else 0) for i, x in enumerate(own[2:])]
        quiet, loud = rows[0][OUTSIDE], np.array([_FORBIDDEN, rows[0][BEGIN], _FORBIDDEN])
        for row in rows[1:]:
            step = (loud[:, None] + self.move).max(0) + row
            step[BEGIN] = max(step[BEGIN], quiet + self.move[OUTSIDE, BEGIN] + row[BEGIN])
            quiet, loud = quiet + self.move[OUTSIDE, OUTSIDE] + row[OUTSIDE], step
        return bool(loud.max() < quiet - 1e-6)

    def level(self, form: bytes) -> int:
        """What is certain of all runs of a form."""
        found = self.levels.get(form)
        if found is None:
            if len(form) > CACHE_CHARS:
                return LOUD
            whole = form.decode()
            tokens = _TOKEN.findall(whole)
            own, most = own_features(whole, tokens), self._open(whole, tokens)
            found = LOUD if not self._only_outside(own, False, most) else DULL if self._only_outside(own, True, most) else CALM
            if len(self.levels) >= CACHE_RUNS or len(self.paths) >= CACHE_RUNS:
                self.forget()
            self.levels[form] = found
        return found

    def learn(self, names: list[list[str]], gold: list[int], rate: float) -> None:
        """One step up the log-likelihood of ``gold``, by forward and backward sums."""
        s, n = self.scores(names), len(names)
        fore, aft = np.zeros((n, 3)), np.zeros((n, 3))
        fore[0] = s[0]
        for i in range(1, n):
            fore[i] = s[i] + np.logaddexp.reduce(fore[i - 1][:, None] + self.move, axis=0)
        for i in range(n - 2, -1, -1):
            aft[i] = np.logaddexp.reduce(self.move + (s[i + 1] + aft[i + 1])[None, :], axis=1)
        total = np.logaddexp.reduce(fore[-1])
        near = -np.exp(fore + aft - total)
        for i, y in enumerate(gold):
            near[i, y] += 1
            for name in names[i]:
                w = self.weights.setdefault(name, np.zeros(3))
                w += rate * (near[i] - PENALTY * w)
        for i in range(1, n):
            both = np.exp(fore[i - 1][:, None] + self.move + (s[i] + aft[i])[None, :] - total)
            step = -both
            step[gold[i - 1], gold[i]] += 1
            step[OUTSIDE, INSIDE] = 0
            self.move += rate * step


def training_line(r: random.Random) -> tuple[str, tuple[int, int] | None]:
    """A generated line and where its secret stands, if it holds one."""
    pick = lambda chars, a, b: "".join(r.choices(chars, k=r.randint(a, b)))
    low, up, num, mixed = string.ascii_lowercase, string.ascii_uppercase, string.digits, string.ascii_letters + string.digits
    word = lambda: pick(low, 2, 9)
    prose = " ".join(word() for _ in range(r.randint(2, 8)))
    camel = lambda a, b: "".join(pick(low, 3, 8).title() for _ in range(r.randint(a, b)))
    hint = lambda: r.choice(["auth", "Bearer", "credentials", "client_key", "private_key", "access", "pwd", "pass", "passwd", "password", "secret", "token", "session", "Authorization: Bearer", "key", "signature"])
    glue = r.choice([" = ", "=", ": ", " ", ' = "', ": '", " := "])
    lead = r.choice(["", prose + " ", "export ", "  "])
    if r.random() < 0.15:
        # Short secrets and ones without a digit, told by what stands before them.
        secret = r.choice([
            lambda: pick(low, 1, 2) + pick(up, 1, 2) + pick(mixed, 3, 5) + r.choice(num) + pick(low, 0, 2),
            lambda: pick(up, 1, 2) + pick(low, 1, 2) + r.choice(num) + pick(mixed, 3, 6),
            lambda: pick(low, 3, 8) + camel(2, 4),
            lambda: pick(low, 16, 16),
            lambda: pick(low, 16, 24),
            lambda: pick(low + up, 18, 44),
        ])()
        head = f"{lead}{hint()}{glue}"
        return head + secret + r.choice(["", '"', "'", ";", "\n", " " + prose]), (len(head), len(head) + len(secret))
    if r.random() < 0.4:
        secret = r.choice([
            lambda: pick(mixed, 20, 44),
            lambda: f"{pick(low, 2, 4)}_{pick(mixed, 24, 40)}",
            lambda: f"{pick(low, 2, 3)}_{r.choice(['live', 'test', 'prod'])}_{pick(mixed, 20, 32)}",
            lambda: ".".join(pick(mixed + "-_", 16, 40) for _ in range(3)),
            lambda: pick(mixed + "+/", 28, 60) + "=" * r.randint(0, 2),
            lambda: f"{pick(up, 3, 4)}{pick(up + num, 16, 20)}",
            lambda: pick("0123456789ABCDEF", 32, 64),
        ])()
        while not any(c.isdigit() for c in secret) or not any(c.isalpha() for c in secret):
            secret += r.choice(num + low)
        name = r.choice(["auth", "Bearer", "credentials", "client_key", "private_key", "access", "pwd", "session", "Authorization: Bearer", "key", "signature", word(), prose])
        head = f"{lead}{name}{glue}"
        return head + secret + r.choice(["", '"', "'", ";", "\n", " " + prose]), (len(head), len(head) + len(secret))
    other = r.choice([
        lambda: f"+{pick(num, 1, 2)} ({pick(num, 3, 3)}) {pick(num, 3, 3)}-{pick(num, 4, 4)}",
        lambda: pick(num, 12, 19),
        lambda: "-".join(pick(num, 4, 4) for _ in range(4)),
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: f"{word()}.{word()}@{word()}{r.randint(1, 99)}.com",
        lambda: f"https://{word()}.example.com/{word()}/{pick(num, 3, 8)}.html",
        lambda: "/".join(word() for _ in range(4)) + f"/{word()}{r.randint(1, 99)}.txt",
        lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)) + f":{r.randint(80, 9999)}",
        lambda: f"{word()}-{r.randint(1, 20)}.{r.randint(0, 20)}.{r.randint(0, 20)}.tar.gz",
        lambda: f"{word()}{word()}{r.randint(1, 9999)}",
        lambda: f"{word()}_{word()}_{r.randint(1, 99)}",
        lambda: f"{r.randint(0, 10**9)}.{r.randint(0, 10**9)}",
        lambda: f"{hint()}{glue}{word()}",
        lambda: f"{hint()} {prose}",
        lambda: f"{hint()}{glue}{r.choice(['None', 'null', 'true', 'False', word().title(), word().upper(), word() + camel(1, 2) + '(', word() + '_' + word() + '('])}",
        lambda: r.choice([word().title(), word().upper(), camel(2, 3), word() + camel(1, 3), pick(low, 10, 22), f"{word()}-{word()}"]),
        lambda: "-" * r.randint(5, 30) + f"{r.randint(1, 9)}" + "-" * r.randint(5, 30),
    ])()
    return f"{prose}{r.choice([' ', ': ', ' = ', ', '])}{other}{r.choice([' ', '. ', chr(10)])}{prose}", None


@functools.cache
def trained(seed: int = SEED, lines: int = TRAIN_LINES, epochs: int = EPOCHS) -> Model:
    r, model, data = random.Random(seed), Model(), []
    for _ in range(lines):
        line, secret = training_line(r)
        file = (f"file:code={r.randint(0, 4)}", f"file:lines={r.randint(0, 4)}")
        for start, end in secret_runs(line):
            at = context(line, start, end)
            if not (secret and secret[0] <= start < secret[1]) and not at[0] and line[start:end].isalpha() and r.random() < 0.7:
                continue  # plain words abound
            tokens = run_tokens(line, start, end)
            inside = [bool(secret) and secret[0] <= a and b <= secret[1] for a, b in tokens]
            gold = [OUTSIDE if not x else INSIDE if i and inside[i - 1] else BEGIN for i, x in enumerate(inside)]
            data.append((features(line, start, end, tokens, file), gold))
    for epoch in range(epochs):
        r.shuffle(data)
        for names, gold in data:
            model.learn(names, gold, RATE / (1 + epoch) / 4)
    return model


def _long_path(text: str, start: int, end: int, tokens: list[tuple[int, int]], of_file: tuple[str, ...], model: Model) -> list[int]:
    """The best path of a run of any length, its features made block by block."""
    shared, at = run_features(text[start:end]), context(text, start, end)
    shape = lambda k, other: _shape(text[slice(*tokens[k])]) if 0 <= k < len(tokens) else other
    blocks = (
        named((*shared, *token_features([text[a:b] for a, b in tokens[k : k + BLOCK]], k == 0, shape(k - 1, "^"), shape(k + BLOCK, "$"))), at, of_file)
        for k in range(0, len(tokens), BLOCK)
    )
    return model.decode(blocks)


def _doubtful(forms: str, levels: dict[str, int], zones: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that are loud, and calm ones with a hint before them, in order; ``forms`` is the text with its classes for letters."""
    found, n = set(), len(forms)
    for form, level in levels.items():
        at = forms.find(form) if level == LOUD else -1
        while at >= 0:
            end = at + len(form)
            if (at == 0 or forms[at - 1] not in _RUN_SIGNS) and (end == n or forms[end] not in _RUN_SIGNS):
                found.add((at, end))
            at = forms.find(form, at + 1)
    for low, high in zones:
        for m in _RUN.finditer(forms, low):
            start, end = m.span()
            if start > high:
                break
            if m[0] in levels and (start == 0 or forms[start - 1] not in _RUN_SIGNS):
                found.add((start, end))
    return sorted(found)


def crf_spans(text: str, model: Model, low: str | None = None) -> list[tuple[int, str, int]]:
    """Spans of the best path of a text."""
    raw = text.encode("utf-8", "replace").translate(_BYTE_CLASSES)
    levels = {form: x for form in set(_BYTE_RUN.findall(raw)) if (x := model.level(form)) != DULL}
    if not levels:
        return []
    low = text.lower() if low is None else low
    zones = hint_zones(low) if len(low) == len(text) else [(0, len(text))]
    if not zones and LOUD not in levels.values():
        return []
    of_file, out = file_features(text), []
    for start, end in _doubtful(text.translate(_CLASSES), {form.decode(): x for form, x in levels.items()}, zones):
        tokens = None
        if end - start <= CACHE_CHARS:
            path = model.path(text[start:end], context(text, start, end), of_file)
            if not any(path):
                continue
        else:
            tokens = run_tokens(text, start, end)
            path = _long_path(text, start, end, tokens, of_file, model)
        at = None
        for (a, b), tag in zip([*(tokens or run_tokens(text, start, end)), (end, end)], [*path, OUTSIDE], strict=True):
            if at is not None and tag != INSIDE:
                out.append((at, "crf", last))
                at = None
            if tag == BEGIN:
                at = a
            last = b
    return out


def find_spans(text: str, model: Model) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base spans, all spans): the CRF adds those that reach beyond every base span."""
    low = text.lower()
    base, more, k, reach = base_spans(text, low), [], 0, 0
    for s in crf_spans(text, model, low):
        while k < len(base) and base[k][0] <= s[0]:
            reach = max(reach, base[k][2])
            k += 1
        if s[2] > reach:
            more.append(s)
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1])))


def _model_of(docs: DataFrame):
    prepare(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(trained())  # a few thousand features, whatever the input


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"


def scan(docs: DataFrame) -> DataFrame:
    """Spans of secrets in every text.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf.
    Null text: as empty, no spans. Null doc_id: kept. Repeated rows: a row
    each. Of paths that score alike, the one with fewer and later secrets.
    Empty table: no rows. Other columns are ignored. Texts are read whole.
    """
    model = _model_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("runs", model.value.forget)
        for batch in batches:
            for part in text_slices(batch):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    base, spans = find_spans(text or "", model.value)
                    n = [sum(s[1] == k for s in spans) for k in KINDS]
                    rows.append((doc, *n[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n[3]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)


def mask(text: str, spans: list[tuple[int, str, int]], sign: str = "[SECRET]") -> str:
    """``text`` with every span replaced; spans that overlap share one sign."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], sign]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in ``text`` and ``n_chars`` set anew; other columns and rows stay.

    Null text: stays null, and so does its n_chars. Empty and very long texts,
    null doc_ids, repeats and empty tables: as in :func:`scan`.
    """
    model = _model_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("runs", model.value.forget)
        for batch in batches:
            for part in text_slices(batch):
                texts = [None if t is None else mask(t, find_spans(t, model.value)[1]) for t in part.column("text").to_pylist()]
                part = part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
                if (i := part.schema.get_field_index("n_chars")) >= 0:
                    part = part.set_column(i, "n_chars", pa.array([None if t is None else len(t) for t in texts], part.schema.field(i).type))
                yield part

    return docs.mapInArrow(run, docs.schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
