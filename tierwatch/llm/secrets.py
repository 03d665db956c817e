"""Secret scans: candidates in whole texts, and a random forest that drops the false ones.

A candidate is a long run with a digit of the characters that keys are made of, a whole block of a private
key, or whatever is given to something like a password, at any length: the whole quoted value or all up to the
next blank, what follows `Bearer`, and the password in a URL. Where several meet, all are candidates. The
forest looks at length, transitions between kinds of characters, coverage by dictionary words, the path or
source of the text, and the words around. It learns from labelled findings: those of the corpus whose assignment or shape decides them,
up to a bound, and examples made by rule for formats that a corpus may lack. Every tree is grown in a
task of its own.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwatch.functions.shared import stage
from tierwatch.llm import texts
from tierwatch.llm.rows import map_rows

LEAST_RUN = 16
LEAST_NEAR = 6  # of a run that only stands near a credential; what is given to one has no least length
LABELLED_ROWS = 4000
MADE_ROWS = 4000
TREES = 24
TREE_DEPTH = 9
LEAST_LEAF = 3
BINS = 32
AROUND = 48
MASK = "[SECRET]"

# Words that names, hosts and placeholders are made of.
DICTIONARY = (
    "access admin api app auth backup base branch build bucket cache client cloud code commit com config content data "
    "date default demo dev doc docs domain dummy email example event file files final form foo bar guide host html http "
    "https id image images index info input item java key lib link list local log login mail main master message model "
    "module name net node number object org output page password path php placeholder port private product profile "
    "project public python query readme release report request resource response root sample script secret server "
    "service session site size sort source static status store string style system table tag task template test text "
    "time title token type update upload url user users value version video view web week word work www year your"
).split()
COMMON = (
    "a about after again all also an and any are as at be because been before being both but by can could did do does "
    "each few for from had has have he her here him his how if in into is it its just like more most must my new no not "
    "now of off old on once one only or other our out over own same set she should so some such than that the their them "
    "then there these they this too two under until up us very was we were what when where which while who why will with you"
).split()
# `pass` and the like count as a part of a name, or where a name ends with it before its value.
PASSWORD = re.compile(
    rb"passw(?:or)?d|passphrase|pwd|(?<![a-z])(?:pass(?:code|key)?|pin(?:[ _-]?code)?|otp|creds?)(?![a-z])|pass(?=[\"'`\])]{0,3}\s*[=:])"
)
CREDENTIAL = re.compile(
    rb"token|secret|api[ _-]?key|access[ _-]?key|auth|bearer|credential|private[ _-]?key|client[ _-]?key|" + PASSWORD.pattern
)
MEASURED = re.compile(rb"tokens|count|length|size|limit|max|min(?![a-z])|number|policy|ttl|expir|timeout|retries|attempts|type|field|name|label")
NOT_CREDENTIAL = re.compile(rb"commit|sha-?\d*|md5|checksum|digest|hash|uuid|guid|version|revision|etag|color|img|image|file|href|src|url|http|isbn|phone|tel|order|invoice|build")
ASSIGNS = re.compile(rb"(?:=|:|=>|\bis)\s*[\"'`]?$|bearer\s+$", re.I)
PREFIXES = (b"akia", b"asia", b"ghp_", b"gho_", b"ghs_", b"github_pat_", b"sk-", b"sk_live_", b"xoxb-", b"xoxp-", b"aiza", b"eyj", b"glpat-", b"hf_", b"-----begin")
# What leads to a value, and the value: quoted, or all up to the next blank.
LEADS = re.compile(rb"(?:" + CREDENTIAL.pattern + rb")[\w.-]{0,64}+[\"'`\])]{0,3}+\s*+(?:[=-]>|:=|={1,3}|:|(?<=\s)(?:is|was)(?=[\s:]):?)\s*+|\bbearer\s++")
VALUE = re.compile(rb"\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`|(\S++)")
URL_PASSWORD = re.compile(rb"://[^\s/:@]*+:([^\s/]+)@")
_KEY_HEAD = rb"[a-z0-9 ]{0,40}private key(?: block)?-----"
# To its end, or where the end is missing, as far as lines of a key go on.
KEY_BLOCK = re.compile(
    rb"-----begin " + _KEY_HEAD + rb"(?:(?:(?!-----)[a-z0-9+/=\s,:.;()\\\"'-])*+-----end " + _KEY_HEAD
    + rb"|(?:(?:\s|\\[nr]|[\"',])*+[a-z0-9+/=]{16,}+)*+)"
)
IN_URL = re.compile(rb"://[^\s/:@]*:$")
PAIRS = {41: b"(", 93: b"[", 125: b"{", 62: b"<"}
SAMPLE_PATH = re.compile(r"test|example|sample|doc|demo|fixture|mock", re.I)

_WORDS = sorted((w.encode() for w in DICTIONARY if len(w) > 2), key=len, reverse=True)
_COVER = re.compile(b"|".join(_WORDS))
_KINDS = np.zeros(256, np.uint8)  # 0: not part of a key
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58] = 1, 2, 3
_KINDS[list(b"+/_-.~")] = 4
_VOWELS = np.isin(np.arange(256), list(b"aeiouyAEIOUY"))
_HEX = np.isin(np.arange(256), list(b"0123456789abcdefABCDEF"))

FEATURES = (
    "length", "digits", "lower", "upper", "signs", "hex_only", "transitions", "digit_transitions", "distinct",
    "entropy", "vowels", "longest_letters", "longest_same", "coverage", "prefix", "credential_near", "other_near",
    "assigned", "quoted", "after_at", "dots", "sample_path", "path_length", "mixed_case", "separators_even",
    "in_url", "other_signs", "blanks", "password_near", "measured",
)


def features(run: bytes, before: bytes, after: bytes, path: str) -> list[float]:
    """What the forest sees of a candidate, the bytes around it and the path of its text."""
    codes = np.frombuffer(run, np.uint8)
    kind = _KINDS[codes]
    n = len(codes)
    counts = np.bincount(codes)
    share = counts[counts > 0] / n
    change = np.diff(kind) != 0
    letters = (kind == 1) | (kind == 2)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], letters.astype(np.int8), [0]])))
    longest = int((edges[1::2] - edges[::2]).max(initial=0))
    same = np.flatnonzero(np.diff(np.concatenate([[-1], codes.astype(int), [-1]])))
    low, head = run.lower(), before.lower()
    covered = sum(len(m) for m in _COVER.findall(low))
    parts = [len(p) for p in re.split(rb"[-_./]", run)]
    credential = max((m.end() for m in CREDENTIAL.finditer(head)), default=0)
    other = max((m.end() for m in NOT_CREDENTIAL.finditer(head)), default=0)
    password = max((m.end() for m in PASSWORD.finditer(head)), default=0)
    return [
        np.log1p(n), (kind == 3).mean(), (kind == 1).mean(), (kind == 2).mean(), (kind == 4).mean(),
        float(_HEX[codes].all()), change.mean() if n > 1 else 0.0,
        float(((kind[1:] == 3) != (kind[:-1] == 3)).mean()) if n > 1 else 0.0, len(share) / n,
        float(-(share * np.log2(share)).sum()), float(_VOWELS[codes].sum() / max(int(letters.sum()), 1)), longest / n,
        int(np.diff(same).max(initial=1)) / n, covered / n, float(low.startswith(PREFIXES)),
        credential / (len(head) + 1), other / (len(head) + 1), float(bool(ASSIGNS.search(before))),
        float(before[-1:] in (b'"', b"'", b"`") and after[:1] in (b'"', b"'", b"`")),
        float(before[-1:] == b"@" or after[:1] == b"@"), run.count(b".") / n, float(bool(SAMPLE_PATH.search(path))),
        np.log1p(len(path)), float((kind == 1).any() and (kind == 2).any()), float(len(parts) > 1 and min(parts) == max(parts)),
        float(bool(IN_URL.search(before))), (kind == 0).mean(), float((codes == 32).mean()),
        password / (len(head) + 1), float(bool(MEASURED.search(head[-24:]))),
    ]


def given_values(text: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of the values given to a credential in a text in lower case, of passwords in URLs, and of
    blocks of private keys."""
    for lead in LEADS.finditer(text):
        value = VALUE.match(text, lead.end())
        if value is None:
            continue
        a, b = value.span(value.lastindex)
        if value.lastindex == 4:
            while a < b and text[a] in b"\"'`([{<":
                a += 1
            # Signs that end a sentence, and brackets that were opened before the value.
            while a < b and (text[b - 1] in b".,;:~\"'`" or (text[b - 1] in PAIRS and PAIRS[text[b - 1]] not in text[a:b])):
                b -= 1
        if b > a:
            yield a, b
    for found in URL_PASSWORD.finditer(text):
        yield found.span(1)
    for found in KEY_BLOCK.finditer(text):
        yield found.span()


def candidates(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(document, start, end) of the candidates of each text, in order; they may overlap."""
    if not len(data):
        return
    found = set(_runs(data, offsets))
    low = texts.lower_ascii(data).tobytes()
    for doc, (first, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        found.update((doc, first + a, first + b) for a, b in given_values(low[first:end]))
    yield from sorted(found)


def _runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(document, start, end) of the candidate runs of each text."""
    kind = _KINDS[data]
    inside = kind > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts[1:] - 1] |= inside[cuts[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    digits = np.concatenate([[0], np.cumsum(kind == 3)])
    length = ends - starts
    long = (length >= LEAST_RUN) & (digits[ends] > digits[starts])
    # Shorter runs, or runs without a digit, only right after an assignment.
    owner = np.searchsorted(offsets, starts, "right") - 1
    sign = np.zeros(len(starts), bool)
    for back in range(1, 4):
        at = starts - back
        near = np.where(at >= offsets[owner], data[np.maximum(at, 0)], 0)
        sign |= (near == 61) | (near == 58)
    for i in np.flatnonzero(long | (sign & (length >= LEAST_NEAR))).tolist():
        a, b, doc = int(starts[i]), int(ends[i]), int(owner[i])
        if not long[i]:
            before = data[max(a - AROUND, int(offsets[doc])) : a].tobytes().lower()
            if not (ASSIGNS.search(before) and CREDENTIAL.search(before)):
                continue
        while b > a and data[b - 1] in b".~":  # signs that end a sentence
            b -= 1
        if b > a:
            yield doc, a, b


def described(data: np.ndarray, offsets: np.ndarray, paths: list[str]) -> Iterator[tuple[int, int, int, list[float], int]]:
    """Candidates with their features and, where their surroundings decide it, their label (else -1)."""
    for doc, a, b in candidates(data, offsets):
        low, high = int(offsets[doc]), int(offsets[doc + 1])
        run = data[a:b].tobytes()
        before, after = data[max(a - AROUND, low) : a].tobytes(), data[b : min(b + AROUND, high)].tobytes()
        yield doc, a, b, features(run, before, after, paths[doc]), label_of(run, before, after)


def label_of(run: bytes, before: bytes, after: bytes) -> int:
    """1 for a quoted value assigned to a credential, 0 for numbers, hosts and plain words, else -1."""
    tail = before.lower()[-24:]
    quoted = before[-1:] in (b'"', b"'") and after[:1] == before[-1:]
    sound = b" " not in run and not _COVER.search(run.lower())
    if KEY_BLOCK.fullmatch(run.lower()) and len(run) > 80:
        return 1
    if quoted and ASSIGNS.search(before) and CREDENTIAL.search(tail) and sound and len(run) >= LEAST_NEAR:
        return 1
    if IN_URL.search(before) or (ASSIGNS.search(before) and PASSWORD.search(tail)):
        return -1
    if run.isdigit() or before[-1:] == b"@" or re.fullmatch(rb"[a-z]+(?:\.[a-z0-9]+)+", run.lower()):
        return 0
    return -1


def made_findings(n: int = MADE_ROWS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of findings made by rule: secrets of known formats, and what looks like them."""
    pick = random.Random(seed)
    draw = lambda letters, k: "".join(pick.choice(letters) for _ in range(k))
    hexes, mixed, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    word = lambda: pick.choice(DICTIONARY)
    real = (
        lambda: draw(hexes, pick.choice((32, 40, 64))), lambda: draw(hexes, pick.choice((32, 40, 64))).upper(),
        lambda: draw(mixed, pick.randint(20, 64)), lambda: draw(mixed + "+/", pick.randint(32, 88)),
        lambda: "AKIA" + draw(upper, 16), lambda: "ghp_" + draw(mixed, 36), lambda: "sk-" + draw(mixed, pick.randint(32, 48)),
        lambda: "xoxb-" + draw(string.digits, 12) + "-" + draw(mixed, 24),
        lambda: draw(mixed + "_-", pick.randint(8, 20)), lambda: "eyJ" + draw(mixed + "_-", 60) + "." + draw(mixed + "_-", 43),
    )
    fake = (
        lambda: f"{word()}_{word()}_{draw(string.digits, pick.randint(1, 8))}", lambda: draw(string.digits, pick.randint(16, 20)),
        lambda: "-".join(draw(hexes, k) for k in (8, 4, 4, 4, 12)), lambda: f"{word()}{pick.randint(1, 99)}.{word()}.com",
        lambda: f"{word()}/{word()}/{word()}-{pick.randint(1, 999)}.{word()}", lambda: f"your-{word()}-{word()}-here1",
        lambda: f"{word().title()}{word().title()}{word().title()}{pick.randint(1, 99)}", lambda: "x" * pick.randint(8, 24) + "1234",
        lambda: f"20{draw(string.digits, 2)}-{draw('01', 2)}-{draw('012', 2)}T{draw('01', 2)}.{draw('0123', 2)}",
        lambda: draw(hexes, pick.choice((7, 32, 40, 64))), lambda: f"{word()}-{word()}-v{pick.randint(1, 9)}.{pick.randint(0, 20)}.{pick.randint(0, 9)}",
    )
    letters, signs = string.ascii_lowercase, "!$%&*?@#^+="
    spoken = lambda: "".join(draw("bcdfghjklmnprstvwxyz", 1) + draw("aeiou", 1) + draw(letters, pick.randint(0, 1)) for _ in range(pick.randint(2, 4)))
    passwords = (
        lambda: spoken() + draw(string.digits, pick.randint(1, 4)),
        lambda: spoken().title() + draw(signs, 1) + draw(string.digits, pick.randint(1, 4)),
        lambda: spoken() + draw(string.digits, 1) + draw(signs, 1) + spoken() + draw(signs, 1) + draw(letters, 3),
        lambda: spoken() + draw(string.digits, pick.randint(1, 3)) + draw(letters, 3), lambda: draw(mixed + signs, pick.randint(8, 24)),
        lambda: draw(mixed, pick.randint(8, 14)) + draw(string.digits, 1), lambda: spoken().title().replace("a", "@").replace("o", "0") + draw(signs, 1) + "20" + draw(string.digits, 2),
    )
    prose = "required missing invalid expired wrong needed shared stored stronger never always checked changed rotated generated".split()
    harmless = (
        lambda: pick.choice(prose), lambda: pick.choice(DICTIONARY) + pick.choice(("", "s", ".", "_name")), lambda: "${" + word().upper() + "}",
        lambda: f"<your-{word()}>", lambda: f"os.environ['{word().upper()}']", lambda: " ".join(pick.choice((*prose, *DICTIONARY)) for _ in range(pick.randint(2, 8))),
        lambda: pick.choice(("undefined", "******", "xxxxxxxx", "[redacted]", "{{ " + word() + " }}", word() + "()")),
    )
    names = ("token", "secret", "api_key", "apiKey", "password", "client_secret", "access_key", "auth_token", "private_key")
    words = ("pass", "DB_PASS", "db_pass", "dbPass", "pin", "user_pin", "passcode", "otp", "creds", "pwd", "password", "PIN")
    rounds = "max_tokens token_count tokens password_length pin_length token_limit pass_count min_pass auth_timeout token_ttl passes pin_number_size".split()
    short = (
        *[lambda: draw(string.digits, pick.choice((4, 4, 5, 6, 8)))] * 4, lambda: draw("bcdfghjklmnpqrstvwxz", 3) + draw(string.digits, pick.randint(1, 3)),
        lambda: draw(mixed, pick.randint(4, 7)) + draw(string.digits, 1), lambda: spoken() + draw(string.digits, 2),
        lambda: spoken() + draw(string.digits, pick.randint(1, 2)) + draw(letters, 3), lambda: draw(letters, 3) + draw(signs, 1) + draw(string.digits, 2),
    )
    plain = (
        lambda: pick.choice(COMMON), lambda: pick.choice(prose), lambda: pick.choice(("true", "false", "null", "none", "yes", "no", "on", "off", "0", "1")),
        lambda: pick.choice(DICTIONARY), lambda: pick.choice(COMMON) + pick.choice((".", ",")),
    )
    neutral = ("commit ", "sha256: ", "md5 = ", "checksum: \"", "see ", "file: ", "version ", "uuid=\"", "url: ", "image/", "", "order ", "id: \"")
    paths = ("src/app.py", "config/prod.env", "docs/readme.md", "tests/test_api.py", "src3", "web/page.html", "example/demo.ini")
    rows, labels = [], []
    for i in range(n):
        true = i % 2 == 0
        run = pick.choice(real)() if true else pick.choice(fake)()
        plain_hex = not true and set(run) <= set(hexes)
        if true or (not plain_hex and pick.random() < 0.3):
            quote, join = pick.choice(('"', "'", "")), pick.choice((" = ", "=", ": ", " : "))
            before, after = f"{draw(string.ascii_lowercase + ' ', 12)} {pick.choice(names)}{join}{quote}", quote + "\n"
        else:
            before = f"{draw(string.ascii_lowercase + ' ', 14)} {pick.choice(neutral)}"
            after = '"' if before.endswith('"') else " and"
        if pick.random() < 0.35:  # whatever is given to a credential, or stands in a URL
            run, way = pick.choice(passwords if true else harmless)(), pick.random()
            quote, lead = pick.choice(('"', "'", "")), f"{draw(string.ascii_lowercase + ' ', 12)} "
            join = pick.choice((" = ", "=", ": ", " => ", " is ", ":   ", " : ")) + quote
            before, after = lead + pick.choice(names) + join, quote + "\n"
            if way < 0.2 and true:
                before, after = f"{lead}{word()}://{word()}:", f"@{word()}/{word()}"
            elif way < 0.35 and true:
                before, run, after = lead + "Authorization: Bearer ", pick.choice((draw(mixed, 24), draw(letters, pick.randint(12, 40)))), "\n"
            elif way < 0.1:
                before, run, after = f"{lead}mail: ", f"{word()}.{word()}{pick.randint(1, 99)}", f"@{word()}.com"
        if pick.random() < 0.2:  # short values, and numbers that only measure something
            quote, join = pick.choice(('"', "'", "", "")), pick.choice((" = ", "=", ": ", ":", " is ", " => "))
            lead = draw(letters + " ", pick.randint(0, 14)) + pick.choice((" ", "\n")) if pick.random() < 0.7 else ""
            before, after = f"{lead}{pick.choice(words)}{join}{quote}", quote + pick.choice("\n ;")
            run = pick.choice(short if true else plain)()
            if not true and pick.random() < 0.4:
                before, run = f"{lead}{pick.choice(rounds)}{join}", draw(string.digits, pick.randint(1, 5))
            elif not true and pick.random() < 0.3:
                before = f"{lead}{pick.choice(names)}{join}"
            if true and pick.random() < 0.15:
                kind, lines = pick.choice(("", "RSA ", "EC ", "OPENSSH ")), [draw(mixed + "+/", 64) for _ in range(pick.randint(1, 24))]
                before, after = draw(letters + " ", 14) + "\n", "\n"
                run = f"-----BEGIN {kind}PRIVATE KEY-----\n" + "\n".join(lines) + f"\n-----END {kind}PRIVATE KEY-----"
        if pick.random() < 0.15:
            before, run = before.upper(), run.upper()
        rows.append(features(run.encode(), before.encode(), after.encode(), pick.choice(paths)))
        labels.append(int(true))
    return np.array(rows), np.array(labels)


@dataclass(frozen=True)
class Forest:
    """Trees as arrays of (feature, threshold, left, right, share of secrets)."""

    trees: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        total = np.zeros(len(x))
        for tree in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(TREE_DEPTH + 1):
                at = tree[node]
                inner = at[:, 0] >= 0
                value = x[np.arange(len(x)), np.maximum(at[:, 0], 0).astype(np.int64)]
                node = np.where(inner, np.where(value <= at[:, 1], at[:, 2], at[:, 3]), node).astype(np.int64)
            total += tree[node, 4]
        return total / max(len(self.trees), 1)


def grow_tree(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """A tree on a bootstrap sample; each split looks at a random part of the features, in bins."""
    dice = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    bins = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)], axis=1)
    nodes: list[list[float]] = []

    def split(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        n, ones = len(rows), int(y[rows].sum())
        nodes.append([-1, 0.0, -1, -1, (ones + 0.5) / (n + 1.0)])
        if depth == TREE_DEPTH or n < 2 * LEAST_LEAF or ones in (0, n):
            return at
        best = (1e-12, -1, -1)
        for f in dice.choice(x.shape[1], max(2, int(x.shape[1] ** 0.5)), replace=False).tolist():
            size = len(edges[f]) + 1
            count = np.cumsum(np.bincount(bins[rows, f], minlength=size))[:-1]
            hits = np.cumsum(np.bincount(bins[rows, f], y[rows], size))[:-1]
            ok = (count >= LEAST_LEAF) & (n - count >= LEAST_LEAF)
            if not ok.any():
                continue
            left, right = hits / np.maximum(count, 1), (ones - hits) / np.maximum(n - count, 1)
            gini = count * left * (1 - left) + (n - count) * right * (1 - right)
            gain = np.where(ok, ones * (1 - ones / n) - gini, -1.0)
            cut = int(np.argmax(gain))
            if gain[cut] > best[0]:
                best = (float(gain[cut]), f, cut)
        if best[1] >= 0:
            _, f, cut = best
            below = bins[rows, f] <= cut
            nodes[at][:2] = [f, float(edges[f][cut])]
            nodes[at][2] = split(rows[below], depth + 1)
            nodes[at][3] = split(rows[~below], depth + 1)
        return at

    split(dice.integers(0, len(x), len(x)), 0)
    return np.array(nodes)


def grow_forest(spark: SparkSession, x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """One task per tree over the bounded labelled sample."""
    shared = spark.sparkContext.broadcast((x, y))

    def grow(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                nodes = grow_tree(*shared.value, seed=tree)
                yield pa.RecordBatch.from_arrays([pa.array([tree]), pa.array([nodes.ravel().tolist()])], ["tree", "nodes"])

    grown = spark.range(0, trees, 1, trees).mapInArrow(grow, "tree long, nodes array<double>").collect()
    return Forest([np.array(r["nodes"]).reshape(-1, 5) for r in sorted(grown, key=lambda r: r["tree"])])


def _path_column(docs: DataFrame):
    return F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")


def labelled_sample(docs: DataFrame, labelled_rows: int = LABELLED_ROWS) -> list:
    """(x, y) of findings of `docs` that label themselves: at most `labelled_rows` distinct vectors of
    either label, those with the smallest hash. Copies of a finding count once."""

    def label(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(1).to_pylist()
            for first, end, data, offsets in texts.slices(batch.column(0)):
                rows = [(x, y) for _, _, _, x, y in described(data, offsets, paths[first:end]) if y >= 0]
                x, y = zip(*rows) if rows else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], ["x", "y"]
                )

    found = docs.select(F.col("text").cast("string"), _path_column(docs)).mapInArrow(label, "x array<double>, y int")
    found = found.distinct().withColumn("order", F.xxhash64(F.col("x").cast("string")))
    found = stage(found, "labelled", codec="zstd")
    parts = [found.where(F.col("y") == y).orderBy("order").limit(labelled_rows) for y in (0, 1)]
    return parts[0].unionByName(parts[1]).select("x", "y").collect()


def learn(docs: DataFrame, labelled_rows: int = LABELLED_ROWS) -> Forest:
    """A forest from `labelled_sample` and from `made_findings`."""
    rows = labelled_sample(docs, labelled_rows)
    x, y = made_findings()
    if rows:
        x = np.concatenate([x, np.array([r["x"] for r in rows])])
        y = np.concatenate([y, np.array([r["y"] for r in rows])])
    return grow_forest(docs.sparkSession, x, y)


def findings(docs: DataFrame, forest: Forest) -> DataFrame:
    """One row per candidate: doc_id, start, length (in characters), score, secret, value_sha256.

    A run inside a longer value that was given to a credential has a row of its own.

    The value itself is not returned. Null and empty texts have none. Rows that repeat an id are
    scanned each. Texts without a `source` column or value have an empty path. Other columns are
    ignored; an empty table gives an empty result.
    """
    schema = "doc_id long, start long, length int, score double, secret boolean, value_sha256 string"

    def scan(batches) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_(), pa.string()]
        for batch in batches:
            ids, paths = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, end, data, offsets in texts.slices(batch.column(1)):
                found = list(described(data, offsets, paths[first:end]))
                score = forest.scores(np.array([f[3] for f in found]).reshape(len(found), len(FEATURES)))
                rows = [
                    (
                        ids[first + doc],
                        int(np.count_nonzero((data[offsets[doc] : a] & 0xC0) != 0x80)),
                        int(np.count_nonzero((data[a:b] & 0xC0) != 0x80)),
                        float(s),
                        bool(s >= 0.5),
                        hashlib.sha256(data[a:b].tobytes()).hexdigest(),
                    )
                    for (doc, a, b, _, _), s in zip(found, score)
                ]
                columns = list(zip(*rows)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    whole = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _path_column(docs))
    return whole.mapInArrow(scan, schema)


def scan(docs: DataFrame) -> DataFrame:
    """The findings of `docs` by a forest that learned from them and from made examples."""
    return findings(docs, learn(docs))


def without_secrets(docs: DataFrame) -> DataFrame:
    """`docs`, all rows and columns, with every secret in `text` replaced by `MASK`."""
    forest = learn(docs)
    at, path = docs.columns.index("text"), docs.columns.index("source") if "source" in docs.columns else None

    def clean(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            paths = [p or "" for p in batch.column(path).cast(pa.string()).to_pylist()] if path is not None else [""] * len(column)
            changed: dict[int, str] = {}
            for first, end, data, offsets in texts.slices(column):
                found = list(described(data, offsets, paths[first:end]))
                if not found:
                    continue
                score = forest.scores(np.array([f[3] for f in found]))
                spans: dict[int, list[tuple[int, int]]] = {}
                for (doc, a, b, _, _), s in zip(found, score):
                    if s >= 0.5:
                        spans.setdefault(doc, []).append((a, b))
                for doc, own in spans.items():
                    parts, last = [], int(offsets[doc])
                    for a, b in own:
                        if a >= last:
                            parts += [data[last:a].tobytes(), MASK.encode()]
                        last = max(last, b)
                    changed[first + doc] = b"".join([*parts, data[last : offsets[doc + 1]].tobytes()]).decode()
            if changed:
                rows = column.to_pylist()
                for i, text in changed.items():
                    rows[i] = text
                batch = batch.set_column(at, batch.schema.field(at), pa.array(rows, column.type))
            yield batch

    return map_rows(docs, clean)
