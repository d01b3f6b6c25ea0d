"""Secret scans: base patterns and a linear-chain conditional random field.

The base finds three kinds of spans by pattern.  The field then tags tokens as
secret begin, inside or outside from their shape, the words around them and
features of the whole document, and adds the spans it decodes by Viterbi that
are not inside a base span.  Base spans stay as they are; a redaction covers both.

A token is in the chain if its shape is not a plain word's or number's (letters
with digits, capitals inside, eight characters with a digit, or twenty), if it is
one of the ``NEAR`` tokens behind a key word in its line, or if it is glue between
two such.  Every other token is outside by constraint, which cuts the chain, and
nothing else does, white space and line ends included: decoding each run between
two outside tokens gives exactly the best path of the whole text.

The field is trained in numpy, on at most ``SAMPLE`` documents that the base
finds something in and as many of all documents (smallest hash of the id), and
on lines written from key words and random values, so that it learns the context
of a secret and not the base's list.

Defined results: null text is empty and has no spans.  A document's tokens and
spans don't depend on other rows; repeated rows are scanned each.  Rows with a
null id are scanned but never trained on.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, keyed, pieces, table

# The base patterns, by kind, in the order spans are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(ASSIGN, re.I | re.A)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run of the base's class that is long enough is found whole
MIN_ASSIGN, MIN_ACCESS = 12, 18

#: The bound of the training sample: texts with base spans and texts of any kind, and
#: runs of each, drawn from the whole text.
SAMPLE, RUNS = 600, 48
WRITTEN = 500
STEPS, RATE, L2 = 250, 0.1, 1e-3
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
_TOKEN = re.compile(r"[\w+/=.\-]+|[^\w\s]")
_POSSIBLE = re.compile(r"[0-9]|\S{20}|[a-z][A-Z]")
#: Shapes that no plain word or number has.
_ODD = re.compile(r"[^\W\d_][0-9]|[0-9][^\W\d_]|[a-z][A-Z]")
NEAR = 5
KEY_WORDS = ("password passwd passphrase pass pwd secret token key apikey api auth authorization bearer credential credentials private access "
             "client session cookie signature license hash").split()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


_KEY_WORD = re.compile(rf"(?<![a-z])(?:{'|'.join(KEY_WORDS)})(?![a-z])", re.I)


def possible(token: str) -> bool:
    """Whether a token's own shape lets it be in a secret."""
    return len(token) >= 20 or (len(token) >= 8 and any(c in "0123456789" for c in token)) or bool(_ODD.search(token))


def _in_chain(tokens: list[tuple[int, int, str]], line: str) -> list[bool]:
    """Which tokens of a line are not outside by constraint."""
    may, key, value = [], -NEAR - 1, False
    for i, (a, b, t) in enumerate(tokens):
        # behind a key word, or going on with a value there
        value = i - key <= NEAR or value and tokens[i - 1][1] == a
        password = line[b:b + 1] == "@" and line[a - 1:a] == ":" and _in_address(line, a)
        may.append(possible(t) or (value or password) and any(c.isalnum() for c in t))
        if _KEY_WORD.search(t):
            key = i
    for i in range(1, len(tokens) - 1):  # glue between two possible tokens that touch it
        if may[i - 1] and not may[i] and may[i + 1] and tokens[i - 1][1] == tokens[i][0] and tokens[i][1] == tokens[i + 1][0] and not tokens[i][2][0].isalnum():
            may[i] = True
    return may


def _in_address(line: str, at: int) -> bool:
    """Whether an address with a scheme goes on up to ``at``."""
    begin = line.rfind("://", max(0, at - 80), at)
    return begin >= 0 and not any(c.isspace() for c in line[begin:at])


def _shape(token: str) -> list[str]:
    n = len(token)
    count = Counter(token)
    entropy = -sum(c / n * math.log2(c / n) for c in count.values())
    digits = sum(c.isdigit() for c in token)
    upper, lower = sum(c.isupper() for c in token), sum(c.islower() for c in token)
    flips = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    kind = "digits" if digits == n else "hex" if all(c in "0123456789abcdef" for c in token) else \
        "HEX" if all(c in "0123456789ABCDEF" for c in token) else "word" if token.isalpha() else "ascii" if token.isascii() else "other"
    return [f"len{min(n // 4, 12)}", f"kind_{kind}", f"entropy{int(2 * entropy)}", f"digits{int(5 * digits / n)}", f"flips{min(flips, 8)}",
            f"case{int(upper > 0)}{int(lower > 0)}{int(digits > 0)}", f"kind_{kind}_len{min(n // 8, 6)}",
            f"marks{''.join(c for c in '_-./+=' if c in count)}", f"dots{min(count['.'], 3)}",
            *([f"start_{token[:3]}", f"start_{token[:3]}_{kind}"] if n >= 12 else ())]


def runs(text: str) -> list[list[tuple[int, int, list[str]]]]:
    """The text's runs of possible tokens, each token as (start, end, features)."""
    out, run, at = [], [], 0
    lines = text.split("\n")
    low = text.lower()
    keys = any(k in low for k in KEY_WORDS)
    file = None
    for line in lines:
        if _POSSIBLE.search(line) or keys and _KEY_WORD.search(line):
            tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(line)]
            tokens = [p for t in tokens for p in _parts(t)]
            may = _in_chain(tokens, line)
            file = file or _file_features(text, lines)
            for i, (a, b, _) in enumerate(tokens):
                if may[i]:
                    glued = bool(run) and run[-1][1] == at + a
                    run.append((at + a, at + b, [*_features(tokens, i, line), f"glued{int(glued)}", *file]))
                elif run:
                    out.append(run)
                    run = []
        elif run and line and not line.isspace():  # a line of outside tokens
            out.append(run)
            run = []
        at += len(line) + 1
    return out + [run] if run else out


def _parts(token: tuple[int, int, str]) -> list[tuple[int, int, str]]:
    """A token cut behind a key and its equals sign (key=value), else itself."""
    a, _, t = token
    cut = t.find("=")
    if 0 < cut < len(t.rstrip("=")) - 1:
        return [(a, a + cut, t[:cut]), (a + cut, a + cut + 1, "="), (a + cut + 1, a + len(t), t[cut + 1:])]
    return [token]


def _features(tokens: list[tuple[int, int, str]], i: int, line: str) -> list[str]:
    said = tokens[i][2]
    before = [t for _, _, t in tokens[max(0, i - NEAR):i]]
    after = [t for _, _, t in tokens[i + 1:i + 3]]
    words = re.findall(r"[a-z]+", " ".join(before).lower().replace("_", " ").replace("-", " "))
    near = [w for w in words if w in KEY_WORDS]
    mark = next((t for t in reversed(before) if t not in "\"'`"), "")
    out = ["bias", *_shape(said), f"before_{mark if len(mark) == 1 and not mark.isalnum() else 'word' if mark else 'start'}",
           f"after_{after[0] if after and len(after[0]) == 1 and not after[0].isalnum() else 'word' if after else 'end'}",
           f"quoted{int(bool(before) and before[-1] in chr(34) + chr(39) + '`')}", f"key{min(len(near), 2)}"]
    a, b, _ = tokens[i]
    if _in_address(line, a):
        out.append(f"address_{'password' if line[a - 1:a] == ':' and line[b:b + 1] == '@' else 'other'}")
    odd = f"odd{int(bool(_ODD.search(said)))}"
    out += [odd, f"{odd}_key{int(bool(near))}"]
    if near:
        out.append("key_" + near[-1])
        out.append(f"key_and_{mark if mark in '=:' else 'other'}")
    return out


def _file_features(text: str, lines: list[str]) -> list[str]:
    n = max(1, len(lines))
    return [f"file_assigns{min(3, int(4 * (text.count('=') + text.count(': ')) / n))}", f"file_code{int('{' in text or ';' in text)}",
            f"file_size{min(6, int(math.log10(len(text) + 1) * 2))}"]


class Field:
    """Weights of a linear-chain CRF over begin, inside, outside."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, step: np.ndarray):
        self.names, self.emit, self.step = names, emit, step

    def scores(self, run: list[list[str]]) -> np.ndarray:
        return np.array([self.emit[[self.names[f] for f in fs if f in self.names]].sum(axis=0) for fs in run])

    def decode(self, run: list[list[str]]) -> list[int]:
        """Best tags of a run between two outside tokens."""
        e, step = self.scores(run).tolist(), self.step
        best, back = [e[0][y] + step[OUTSIDE][y] for y in range(3)], []
        for t in range(1, len(e)):
            choice = [max(range(3), key=lambda x: best[x] + step[x][y]) for y in range(3)]
            back.append(choice)
            best = [best[choice[y]] + step[choice[y]][y] + e[t][y] for y in range(3)]
        y = max(range(3), key=lambda x: best[x] + step[x][OUTSIDE])
        tags = [y]
        for choice in reversed(back):
            tags.append(y := choice[y])
        return tags[::-1]


_FORBIDDEN = -1e4


def likelihood(emit: np.ndarray, step: np.ndarray, batch: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of log-likelihoods of runs of one length, by forward-backward, with
    gradients.  ``batch``: run x token x feature index (the last row of ``emit``
    is padding); ``tags``: run x token."""
    e = emit[batch].sum(axis=2)
    n, time, _ = e.shape
    log = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
    a, b = np.empty((n, time, 3)), np.empty((n, time, 3))
    a[:, 0] = e[:, 0] + step[OUTSIDE]
    for t in range(1, time):
        a[:, t] = e[:, t] + log(a[:, t - 1, :, None] + step, 1)
    b[:, -1] = step[:, OUTSIDE]
    for t in range(time - 2, -1, -1):
        b[:, t] = log(step + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
    z = log(a[:, -1] + b[:, -1], 1)
    p = np.exp(a + b - z[:, None, None])
    g = -p
    rows = np.arange(n)
    d_step = np.zeros((3, 3))
    total = -z.sum()
    was = np.full(n, OUTSIDE)
    for t in range(time):
        y = tags[:, t]
        total += (e[rows, t, y] + step[was, y]).sum()
        np.add.at(d_step, (was, y), 1)
        g[rows, t, y] += 1
        if t:
            pair = np.exp(a[:, t - 1, :, None] + step + (e[:, t] + b[:, t])[:, None, :] - z[:, None, None])
            d_step -= pair.sum(axis=0)
        was = y
    total += step[was, OUTSIDE].sum()
    np.add.at(d_step, (was, OUTSIDE), 1)
    d_step[OUTSIDE] -= p[:, 0].sum(axis=0)
    d_step[:, OUTSIDE] -= p[:, -1].sum(axis=0)
    d_emit = np.zeros_like(emit)
    np.add.at(d_emit, batch, np.broadcast_to(g[:, :, None, :], (*batch.shape, 3)))
    return float(total), d_emit, d_step


def _cut(run: list[list[str]], tags: list[int], most: int = 24):
    """A long run in parts for training, cut before tokens that go nothing on."""
    at = 0
    while at < len(run):
        to = min(len(run), at + most)
        while at + 1 < to < len(run) and tags[to] == INSIDE:
            to -= 1
        if to < len(run) and tags[to] == INSIDE:  # one secret of more tokens: its start
            to = at + most
            yield run[at:to], tags[at:to]
            while to < len(run) and tags[to] == INSIDE:
                to += 1
        else:
            yield run[at:to], tags[at:to]
        at = to


def train(examples: list[tuple[list[list[str]], list[int]]], steps: int = STEPS) -> Field:
    """Maximise the penalised likelihood of (features per token, tags) runs."""
    count = Counter(f for run, _ in examples for fs in run for f in fs)
    names = {f: i for i, f in enumerate(sorted(f for f, c in count.items() if c >= 2))}
    pad = len(names)
    width = max((len(fs) for run, _ in examples for fs in run), default=1)
    emit, step = np.zeros((pad + 1, 3)), np.zeros((3, 3))
    step[OUTSIDE, INSIDE] = _FORBIDDEN  # nothing goes on that has not begun
    by: dict[int, tuple[list, list]] = {}
    for run, tags in examples:
        if run:
            for run, tags in _cut(run, tags):
                x, y = by.setdefault(len(run), ([], []))
                x.append([[names.get(f, pad) for f in fs] + [pad] * (width - len(fs)) for fs in run])
                y.append(tags)
    groups = [(np.array(x), np.array(y)) for x, y in by.values()]
    total = sum(len(x) for x, _ in groups)
    g_emit, g_step = np.full_like(emit, 1e-8), np.full_like(step, 1e-8)
    for _ in range(steps if total else 0):
        d_emit, d_step = -L2 * emit, -L2 * step
        for x, y in groups:
            _, a, b = likelihood(emit, step, x, y)
            d_emit, d_step = d_emit + a / total, d_step + b / total
        d_emit[pad] = 0
        d_step[OUTSIDE, INSIDE] = 0
        g_emit, g_step = 0.9 * g_emit + 0.1 * d_emit ** 2, 0.9 * g_step + 0.1 * d_step ** 2
        emit, step = emit + RATE * d_emit / (np.sqrt(g_emit) + 1e-4), step + RATE * d_step / (np.sqrt(g_step) + 1e-4)
    if not total:
        emit[:, :OUTSIDE] = _FORBIDDEN
        names = {"bias": 0}
        emit = np.array([[_FORBIDDEN, _FORBIDDEN, 0.0], [0.0, 0.0, 0.0]])
    return Field(names, emit, step)


def tagged(text: str, secret: list[tuple[int, int]]) -> list[tuple[list[list[str]], list[int]]]:
    """The text's runs with the tags that the given spans put on their tokens."""
    out = []
    for run in runs(text):
        tags, was = [], None
        for a, b, _ in run:
            of = next((s for s in secret if a < s[1] and s[0] < b), None)
            tags.append(OUTSIDE if of is None else INSIDE if of == was else BEGIN)
            was = of
        out.append(([fs for _, _, fs in run], tags))
    return out


def written(n: int = WRITTEN, seed: int = 5) -> list[tuple[list[list[str]], list[int]]]:
    """Tagged lines of key words with random values, and of harmless values."""
    rng = random.Random(seed)
    out = []
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
                 "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"]
    for _ in range(n):
        value = "".join(rng.choices(rng.choice(alphabets), k=rng.randint(16, 64)))
        if not any(c.isdigit() for c in value):
            value += "7"
        key = rng.choice(KEY_WORDS)
        key = rng.choice([key, key.upper(), f"{rng.choice(KEY_WORDS)}_{key}", key.capitalize()])
        mark, quote = rng.choice([" = ", "=", ": ", ":", " ", " := "]), rng.choice(["", "", '"', "'"])
        line = f"of the {key}{mark}{quote}"
        out += tagged(f"{line}{value}{quote} and then", [(len(line), len(line) + len(value))])
        harmless = rng.choice([f"+{rng.randint(1, 99)} ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", ".".join(str(rng.randint(1, 254)) for _ in range(4)),
                               f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"anna.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com",
                               f"https://example.org/a{rng.randint(100, 99999)}/index.html", f"{rng.randint(10**8, 10**11)}", "antidisestablishmentarianism", f"version-{rng.randint(1, 9)}.{rng.randint(0, 99)}.{rng.randint(0, 9)}"])
        out += tagged(f"{rng.choice(['of the', 'see', 'call', 'the key is in', 'by'])} {harmless} and then", [])
        out += _written_words(rng)
        out += _written_formats(rng)
    return out


def _written_words(rng: random.Random) -> list[tuple[list[list[str]], list[int]]]:
    """Tagged lines of secrets in letters alone or of few characters, and of
    plain words behind key words."""
    syllables = "an be cor dis er fo gar hin in ju kel lo mer nos or pa qui ro sta tum ur vel wo yar ze".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    kind = rng.randrange(3)
    if kind == 0:
        value = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=rng.randint(10, 40)))
    elif kind == 1:
        value = "".join(word().capitalize() for _ in range(rng.randint(2, 4)))
    else:
        value = word() + str(rng.randint(1, 9999))
    key, other = rng.choice(KEY_WORDS), rng.choice(KEY_WORDS)
    line = rng.choice([f"of the {key}", f"{other.capitalize()}: {key.capitalize()}", f"my {other} {key}", key]) + rng.choice([" is ", ": ", "=", " = ", " "])
    out = tagged(f"{line}{value} {word()} {word()}", [(len(line), len(line) + len(value))])
    plain = " ".join(word() for _ in range(rng.randint(3, 8)))
    out += tagged(f"{word()} {rng.choice(['the', 'a', 'by', 'of'])} {key} {rng.choice(['is', 'of', 'to', 'and', 'was'])} {plain}", [])
    out += tagged(f"{word()} {rng.choice([word().capitalize() + word().capitalize(), str(rng.randint(1, 99)) + word()[:2], word() + str(rng.randint(1, 9))])} {word()}", [])
    return out


#: How keys of well-known services begin.
PREFIXES = ("sk_live_ sk_test_ pk_live_ rk_live_ ghp_ gho_ ghs_ github_pat_ glpat- xoxb- xoxp- xapp- AIza ya29. SG. npm_ hf_ dop_v1_ shpat_ sq0atp- pypi- "
            "sk-proj- key-").split()
SCHEMES = "postgres postgresql mysql redis amqp mongodb https ftp ssh smtp".split()
_ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def _written_formats(rng: random.Random) -> list[tuple[list[list[str]], list[int]]]:
    """Tagged lines of secrets that no key word announces, of passwords with marks,
    and of values that look like secrets and are none."""
    pick = lambda alphabet, lo, hi: "".join(rng.choices(alphabet, k=rng.randint(lo, hi)))
    word = lambda: pick("abcdefghijklmnoprstuvw", 3, 9)
    quote = rng.choice(["", "", '"', "'"])
    prefix = rng.choice(PREFIXES)
    parts = [pick(_ALNUM, 10, 14) for _ in range(3)] if prefix.startswith("x") else [pick(_ALNUM, 16, 60)]
    token = prefix + "-".join(parts)
    webtoken = ".".join(["eyJ" + pick(_ALNUM, 15, 40), "eyJ" + pick(_ALNUM + "-_", 20, 120), pick(_ALNUM + "-_", 30, 60)])
    out = []
    for value in (token, webtoken):
        line = rng.choice([f"{word()} ", f"{word()} = {quote}", f"{word()}: {quote}", f"curl -H {quote}", "", f"{word()} {word()} {quote}"])
        out += tagged(f"{line}{value}{quote} {word()} {word()}", [(len(line), len(line) + len(value))])
    line = f"{rng.choice([word() + ' ', word() + ' = ' + quote, ''])}{rng.choice(SCHEMES)}://{word()}:"
    value = rng.choice([pick(_ALNUM, 6, 24), pick(_ALNUM + "!$%*~", 8, 20), word().capitalize() + word().capitalize(), word()])
    out += tagged(f"{line}{value}@{word()}.{word()}.com{rng.choice(['', ':' + str(rng.randint(80, 9999)), '/' + word()])}{quote} {word()}", [(len(line), len(line) + len(value))])
    key, mark = rng.choice(KEY_WORDS), rng.choice([": ", "=", " = ", ":", " is "])
    value = pick(_ALNUM, 3, 6) + rng.choice("!#$%&*^~?@") + pick(_ALNUM + "!#$%&*^~?", 3, 12) + pick(_ALNUM, 1, 4)
    line = f"{rng.choice(['', word() + '_', 'the '])}{rng.choice([key, key.upper()])}{mark}{quote}"
    out += tagged(f"{line}{value}{quote}{rng.choice(['', ' ' + word()])}", [(len(line), len(line) + len(value))])
    digits, low = "0123456789", "0123456789abcdef"
    harmless = rng.choice([
        "-".join(pick(low, n, n) for n in (8, 4, 4, 4, 12)), f"+{pick(digits, 1, 2)}-{pick(digits, 3, 3)}-{pick(digits, 4, 4)}-{pick(digits, 4, 4)}", f"978-{pick(digits, 1, 1)}-{pick(digits, 4, 4)}-{pick(digits, 4, 4)}-{pick(digits, 1, 1)}",
        f"INV-{rng.randint(2000, 2030)}-{pick(digits, 5, 6)}", f"src/{word()}/{word().capitalize()}{rng.randint(1, 9)}.java", f"get{word().capitalize()}{word().capitalize()}{rng.randint(1, 9)}()", f"#{pick(low, 6, 6)}",
        ":".join(pick(low, 2, 2) for _ in range(6)), f"https://{word()}.org/{rng.randint(2000, 2030)}/{rng.randint(10, 12)}/{word()}-{word()}-{rng.randint(2, 99)}-{word()}", f"https://{word()}.net:{rng.randint(1000, 9999)}/{word()}{rng.randint(1, 99)}",
        f"{pick('ABCDEFGHIKLMNRSTX', 2, 4)}{pick(digits, 3, 5)}{rng.choice(['', 'Ti', 'x'])}", "C6H12O6", f"{word()}{rng.randint(1, 99)}@{word()}.com", f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}-beta{rng.randint(1, 9)}",
        f"commit {pick(low, 7, 10)}", f"{word()}_{word()}_{rng.randint(1, 99)}_{word()}", f"{rng.randint(1, 31)}T{pick(digits, 2, 2)}:{pick(digits, 2, 2)}:{pick(digits, 2, 2)}Z", f"{word().capitalize()}{word().capitalize()}{word().capitalize()}",
        f"window.{word()}.{word().capitalize()}{word().capitalize()}", f"{word()}.{word()}.{word()}{rng.randint(1, 9)}.com", f"{pick(digits, 4, 4)} {pick(digits, 4, 4)} {pick(digits, 4, 4)}", f"{word()}-{word()}-{word()}-{word()}-{rng.randint(1, 99)}"])
    for said in ("{0} {1} {2} and {0}", "{0} = {1}", rng.choice(["the id {1}, of {0}", "see {1} for {0}", "{0}: {1}"])):
        out += tagged(said.format(word(), harmless, word()), [])
    return out


def examples(docs: DataFrame, n: int = SAMPLE) -> list[tuple[list[list[str]], list[int]]]:
    """Runs of the sampled texts, the base's spans as secrets.  Texts are tagged where
    they lie; of each at most ``RUNS`` runs, with and without a secret, from the whole text."""
    rows = keyed(docs).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64("doc_id", "text"))
    lowest = lambda d: d.select("doc_id", "h").distinct().orderBy("h", "doc_id").limit(n)
    found = rows.where(F.col("text").rlike(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"))
    chosen = lowest(found).unionAll(lowest(rows)).distinct()

    def run(batches):
        for batch in batches:
            out = []
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
                rng = random.Random(h)
                all_runs = tagged(text, [(a, b) for a, _, b in base_spans(text)])
                secret = [r for r in all_runs if any(t != OUTSIDE for t in r[1])]
                plain = [r for r in all_runs if all(t == OUTSIDE for t in r[1])]
                out.append(json.dumps([r for some in (secret, plain) for r in rng.sample(some, min(len(some), RUNS // 2))]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "h": batch.column("h"), "runs": pa.array(out, pa.string())})

    got = rows.join(F.broadcast(chosen), ["doc_id", "h"]).select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, runs string").dropDuplicates(["doc_id", "h"])
    return [(x, y) for r in sorted(got.collect()) for x, y in json.loads(r[2])]


def fit(docs: DataFrame) -> Field:
    """Train on the sample (the base's spans as secrets) and the written lines."""
    return train(written() + examples(docs))


def spans(text: str, field: Field) -> list[tuple[int, int, int]]:
    """All (start, kind, end): the base's, and the field's that are inside none of them."""
    out = base_spans(text)
    base = list(out)
    for run in runs(text):
        tags = field.decode([fs for _, _, fs in run])
        i = 0
        while i < len(run):
            if tags[i] != BEGIN:
                i += 1
                continue
            j = i + 1
            while j < len(run) and tags[j] == INSIDE:
                j += 1
            a, b = run[i][0], run[j - 1][1]
            if not any(s <= a and b <= e for s, _, e in base):
                out.append((a, 3, b))
            i = j
    return sorted(out)


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """One row per document: counts by base kind, the base's digest, all spans."""
    def fn(batch: pa.RecordBatch) -> dict:
        found = [spans(t or "", field) for t in batch.column("text").to_pylist()]
        base = [[x for x in f if x[1] < 3] for f in found]
        n = lambda k: pa.array([sum(x[1] == k for x in f) for f in found], pa.int64())
        return {"doc_id": batch.column("doc_id"), "n_assign": n(0), "n_access": n(1), "n_hex": n(2),
                "base_sha256": pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base], pa.string()),
                "spans": pa.array([listed(f) for f in found], pa.string()), "n_crf": n(3)}

    return arrow_map(keyed(docs), fn, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def redact(text: str, found: list[tuple[int, int, int]], by: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced."""
    out, at = [], 0
    for a, _, b in found:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], by]
        at = b
    return "".join(out) + text[at:]


def op9_secret_scan(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))


def secret_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark; ``n_chars`` follows the
    new text.  Documents without a secret pass unchanged."""
    field = fit(docs)
    at, has_size = docs.columns.index("text"), "n_chars" in docs.columns

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                was = part.column("text").to_pylist()
                now = [t if t is None else redact(t, f) if (f := spans(t, field)) else t for t in was]
                columns = list(part.columns)
                columns[at] = pa.array(now, part.schema.field(at).type)
                if has_size:
                    k = part.schema.names.index("n_chars")
                    sizes = [s if a == b else len(b) for s, a, b in zip(columns[k].to_pylist(), was, now)]
                    columns[k] = pa.array(sizes, part.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
