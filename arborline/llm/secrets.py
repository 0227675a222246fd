"""Secret scanning: candidates, then a random forest that removes false findings.

Candidates are long tokens with a digit, whatever a known key prefix opens, values of any length
and characters assigned to a name with a credential word in it, passwords of urls, and private keys
in armour, over all their lines.

Features are the candidate's length, its character classes and transitions, how much of it
dictionary pieces cover, whether it looks like a path, and the words beside it.  The forest is
trained on a bounded set of labelled findings made by a seeded rule (LABELLED_FINDINGS of them):
keys, tokens and passwords as they are issued against what resembles them (digests of files,
numbers, identifiers, paths, dates).  Dictionary pieces and usual character transitions are taken
from the words of a vocabulary file of fixed size.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidied

#: Findings in the training set, trees, their depth and least leaf.
LABELLED_FINDINGS, TREES, DEPTH, LEAF, SEED = 6000, 30, 9, 4, 20240917
THRESHOLD = 0.5
#: Characters read beside a candidate.
CONTEXT = 40
MASK = "[SECRET]"

#: A run of token characters with a digit in it; LEAST characters or more count.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.\-])(?=[A-Za-z+/_.\-]*+[0-9])[A-Za-z0-9+/_\-](?:[A-Za-z0-9+/_.\-]*[A-Za-z0-9+/_\-])?={0,2}(?![A-Za-z0-9+/_])")
LEAST = 12
# Words that stand beside credentials, words that stand beside harmless digests, key prefixes.
NEAR_SECRET = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth", "bearer", "credential", "private")
NEAR_HARMLESS = ("commit", "sha1", "sha256", "md5", "checksum", "digest", "revision", "uuid", "guid", "isbn", "version", "order", "invoice", "phone", "card", "tracking")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk_live_", "AIza", "glpat-")
#: A known key prefix and what follows, digit or not; LEAST characters or more count.
PREFIXED = re.compile(f"(?:{'|'.join(PREFIXES)})[A-Za-z0-9+/_\\-]*={{0,2}}")
#: An assignment, the name before it, and the value behind it.
ASSIGNED = re.compile(r"[:=][=>]?\s{0,8}")
NAMED = re.compile(f"(?:{'|'.join(NEAR_SECRET)})[A-Za-z0-9_\\-]{{0,32}}[\"'\\]]{{0,2}}\\s{{0,8}}\\Z", re.I)
VALUE = re.compile(r"(?:(?:bearer|basic|token)\s{1,8})?(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"']\S*))", re.I)
#: A private key in armour to its end; without one, the lines of key characters that follow.
ARMOUR = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:(?:(?!-----)[\s\S])*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----|(?:\s*[A-Za-z0-9+/=]{32,}+(?=\s|\Z))*)")
LOGIN = re.compile(r"://[^\s/@:]{0,256}:([^\s/@]+)@")
BEFORE_LOGIN = re.compile(r"://[^\s/@:]*:$")
# What stands in a credential's place without being one.
STAND_INS = ("none", "null", "nil", "true", "false", "yes", "no", "string", "str", "text", "required", "optional", "empty", "password", "secret", "token", "xxx", "xxxxxxxx", "********", "...", "changeme", "your_token_here", "your-password", "<password>", "<token>", "${PASSWORD}", "{{token}}", "$TOKEN", "%s", "os.environ[\"TOKEN\"]", "getpass()", "config.get(key)", "[SECRET]")
FEATURES = ("length", "digits", "upper", "lower", "other", "entropy", "transitions", "switches", "coverage", "slashes", "dots", "hex", "separators", "prefix", "near_secret", "near_harmless", "assigned", "quoted", "sentence_word", "login", "stand_in", "named")


@lru_cache(maxsize=2)
def language(vocab_path: str) -> tuple[frozenset, np.ndarray]:
    """Dictionary pieces (4 letters or more) and log-probabilities of letter transitions."""
    with open(vocab_path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = [w for s in vocab if (w := s.lstrip("Ġ").lower()).isascii() and w.isalpha()]
    counts = np.ones((27, 27))
    for w in words:
        codes = [26, *(ord(c) - 97 for c in w), 26]
        np.add.at(counts, (codes[:-1], codes[1:]), 1)
    return frozenset(w for w in words if len(w) >= 4), np.log(counts / counts.sum(axis=1, keepdims=True))


def features(token: str, before: str, after: str, lang) -> list[float]:
    pieces, trans = lang
    n, low = len(token), token.lower()
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in token]
    share = {k: kinds.count(k) / n for k in "dulo"}
    freq = np.unique(list(token), return_counts=True)[1] / n
    letters = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in low]
    moves = trans[letters[:-1], letters[1:]].mean() if n > 1 else 0.0
    covered, i = 0, 0
    while i < n:
        for size in range(min(14, n - i), 3, -1):
            if low[i : i + size] in pieces:
                covered += size
                i += size
                break
        else:
            i += 1
    left, words = before.lower(), re.findall(r"[a-z_]+", before.lower())
    return [
        n, share["d"], share["u"], share["l"], share["o"], float(-(freq * np.log2(freq)).sum()), float(moves),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, covered / n, token.count("/") + 3 * left.endswith(("/", "\\", ":")), token.count("."),
        float(all(c in "0123456789abcdef" for c in low)), token.count("-") + token.count("_"), float(token.startswith((*PREFIXES, "-----BEGIN "))),
        float(any(w in left[-24:] for w in NEAR_SECRET)), float(any(w in left[-24:] for w in NEAR_HARMLESS)),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(before[-1:] in "\"'" and after[:1] in "\"'" and bool(after)), float(bool(words) and len(words[-1]) > 1 and before[-1:] == " "),
        float(after[:1] == "@" and bool(BEFORE_LOGIN.search(before))), float(low in STAND_INS or token[0] in "$<{%[" or len(set(token)) == 1 or "(" in token or "[" in token),
        float(bool((m := list(ASSIGNED.finditer(before[-24:]))) and NAMED.search(before[: len(before) - len(before[-24:]) + m[-1].start()]))),
    ]


def labelled_findings(n: int = LABELLED_FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """(before, candidate, after, is a secret), half of each, by a seeded rule."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choices(chars, k=k))
    hexa, up, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    syllables = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ch qu ment tion".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(r.randint(2, 6))) + r.choice([" ", ". ", ", ", "\n"])
    wrap = lambda key, v: r.choice([(f"{key} = \"", v, "\" "), (f"{key}=", v, " "), (f"{key}: ", v, " "), (f"{key}='", v, "'"), (f"\"{key}\": \"", v, "\",")])
    out = []
    for i in range(n):
        lead = prose() if r.random() < 0.9 else ""
        if i % 2:
            kind = r.randrange(13)
            if kind == 0:
                b, v, a = "", "AKIA" + pick(up, 16), r.choice([" ", ".", "\n", ""])
            elif kind == 1:
                b, v, a = wrap(r.choice(["token", "api_key", "secret", "auth_token", "access_key"]), pick(hexa, r.choice([32, 40, 64])))
            elif kind == 2:
                b, v, a = wrap(r.choice(["password", "passwd", "pwd", "db_password"]), pick(r.choice([hexa, alnum]), r.randint(12, 24)))
            elif kind == 3:
                b, v, a = "", r.choice(["ghp_", "xoxb-", "sk_live_", "AIza", "glpat-"]) + pick(alnum, r.randint(24, 36)), " "
            elif kind == 4:
                b, v, a = r.choice(["Bearer ", "authorization: ", "secret "]), pick(alnum + "-_", r.randint(32, 64)), " "
            elif kind == 5:
                b, v, a = "", pick(alnum + "+/", 40) + r.choice(["", "="]), r.choice([" ", "\n"])
            elif kind == 6:
                b, v, a = "", r.choice(["AKIA", "ASIA"]) + pick(up[:26], 16), r.choice([" ", ".", "\n", ""])
            elif kind == 7:
                b, v, a = wrap(r.choice(["token", "api_key", "client_secret", "PRIVATE_KEY", "authToken"]), pick(alnum[:52], r.randint(16, 48)))
            elif kind < 11:
                short = r.choice([lambda: word() + str(r.randint(0, 9999)) + r.choice(["", "x9", "!", "#", "-2024!"]), lambda: pick(alnum + "!@#$%^*-_+?~", r.randint(5, 16))])()
                b, v, a = wrap(r.choice(["password", "passwd", "pwd", "db_password", "PASSWORD"]), short)
                if a[:1] in "\"'" and r.random() < 0.2:
                    v = word() + word() + word()
            elif kind == 11:
                name, body = r.choice(["", "RSA ", "EC ", "OPENSSH "]), "\n".join(pick(alnum + "+/", 64) for _ in range(r.randint(1, 12)))
                b, v, a = r.choice(["", "\n"]), f"-----BEGIN {name}PRIVATE KEY-----\n{body}\n-----END {name}PRIVATE KEY-----", "\n"
            else:
                b, v, a = r.choice(["postgres", "mysql", "https", "redis", "amqp"]) + "://" + r.choice(["", word()]) + ":", r.choice([pick(alnum, r.randint(4, 16)), word() + str(r.randint(0, 999))]), "@" + word() + r.choice(["/x ", ":5432 ", " "])
            if kind < 6:
                v = v if any(c.isdigit() for c in v) else v + "7"
        else:
            kind = r.randrange(12)
            if kind == 0:
                b, v, a = r.choice(["commit ", "sha1: ", "md5 ", "checksum ", "revision ", "digest="]), pick(hexa, r.choice([32, 40, 64])), " "
            elif kind == 1:
                b, v, a = "", str(r.randint(10**11, 10**16)), r.choice([" ", ".", ", "])
            elif kind == 2:
                b, v, a = r.choice(["", "/", "http://"]), "/".join(word() for _ in range(r.randint(2, 4))) + f"/{r.randint(1, 9999)}" + r.choice(["", ".html", ".png"]), " "
            elif kind == 3:
                b, v, a = "", word() + r.choice(["_", "-", ""]) + word() + word() + str(r.randint(1, 9999)), " "
            elif kind == 4:
                b, v, a = r.choice(["uuid ", "", "id "]), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), " "
            elif kind == 5:
                b, v, a = "", f"20{r.randint(10, 29)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}-{r.randint(0, 59):02}", " "
            elif kind == 6:
                b, v, a = r.choice(["+1 ", "phone ", "card ", "isbn "]), "-".join(str(r.randint(100, 9999)) for _ in range(r.randint(3, 4))), " "
            elif kind == 7:
                b, v, a = r.choice(["version ", "v", ""]), ".".join(str(r.randint(0, 9999)) for _ in range(4)) + r.choice(["", "-beta1", "-release"]), " "
            elif kind == 8:
                b, v, a = r.choice(["password ", "token ", "secret "]), word() + word() + word() + str(r.randint(1, 99)), " "
            elif kind == 9:
                b, v, a = wrap(r.choice(["password", "token", "secret", "auth", "api_key", "private"]), r.choice(STAND_INS))
            elif kind == 10:
                b, v, a = r.choice(["secret: ", "token: ", "author: ", "private: ", "authors = ", "password: "]), word(), " "
            else:
                b, v, a = "", r.choice(["ASIA", "AIza", "AKIA"]) + r.choice(["-", "_", "/"]) + r.choice([str.lower, str.upper])(word() + word() + word()) + r.choice(["", "-" + word()]), " "
        out.append((lead + b, v, a + prose(), i % 2))
    return out


class Forest:
    """Random forest of binary splits on the Gini index; trees are arrays."""

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Forest:
        rng, self.trees = np.random.default_rng(seed), []
        tries = max(1, int(np.sqrt(x.shape[1])) + 1)
        for _ in range(TREES):
            rows, nodes = rng.integers(0, len(y), len(y)), []

            def grow(at: np.ndarray, depth: int) -> int:
                me = len(nodes)
                nodes.append([-1, 0.0, 0, 0, float(y[at].mean())])
                if depth == DEPTH or len(at) < 2 * LEAF or y[at].min() == y[at].max():
                    return me
                best = None
                for f in rng.choice(x.shape[1], tries, replace=False):
                    order = at[np.argsort(x[at, f], kind="stable")]
                    v, ones = x[order, f], np.cumsum(y[order])
                    k = np.arange(1, len(at))
                    ok = (v[1:] > v[:-1]) & (k >= LEAF) & (len(at) - k >= LEAF)
                    if ok.any():
                        p, q = ones[:-1] / k, (ones[-1] - ones[:-1]) / (len(at) - k)
                        gini = np.where(ok, k * p * (1 - p) + (len(at) - k) * q * (1 - q), np.inf)
                        i = int(gini.argmin())
                        if best is None or gini[i] < best[0]:
                            best = (gini[i], int(f), float((v[i] + v[i + 1]) / 2))
                if best:
                    left = x[at, best[1]] <= best[2]
                    nodes[me][:2] = [best[1], best[2]]
                    nodes[me][2] = grow(at[left], depth + 1)
                    nodes[me][3] = grow(at[~left], depth + 1)
                return me

            grow(rows, 0)
            self.trees.append([np.array(c) for c in zip(*nodes, strict=True)])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, cut, left, right, p in self.trees:
            at = np.zeros(len(x), dtype=int)
            for _ in range(DEPTH):
                inner = f[at] >= 0
                go = x[np.arange(len(x)), np.maximum(f[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += p[at]
        return total / len(self.trees)


def train(vocab_path: str, n: int = LABELLED_FINDINGS, seed: int = SEED) -> Forest:
    lang = language(vocab_path)
    found = labelled_findings(n, seed)
    return Forest().fit(np.array([features(v, b[-CONTEXT:], a[:CONTEXT], lang) for b, v, a, _ in found]), np.array([y for *_, y in found], dtype=float))


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end), in order and without repeats; they may overlap."""
    found = {m.span() for m in CANDIDATE.finditer(text) if m.end() - m.start() >= LEAST}
    for m in PREFIXED.finditer(text):
        if m.end() - m.start() >= LEAST and not (m.start() and re.match(r"[A-Za-z0-9+/_.\-]", text[m.start() - 1])):
            found.add(m.span())
    upto = 0  # no assignment is looked for within a value
    for m in ASSIGNED.finditer(text):
        if m.start() >= upto and NAMED.search(text, max(0, m.start() - 64), m.start()) and (v := VALUE.match(text, m.end())):
            a, b = v.span(v.lastindex)
            if v.lastindex == 3:
                b = a + (len(text[a:b].rstrip(",;.)]}>\"'")) or b - a)
            upto = b
            found.add((a, b))
    found |= {m.span(1) for m in LOGIN.finditer(text)} | {m.span() for m in ARMOUR.finditer(text)}
    return sorted(found)


def scan(texts: list[str | None], forest: Forest, lang) -> list[list[tuple[int, int, float]]]:
    """(start, end, score) of the findings of each text."""
    spots = [(i, a, b) for i, t in enumerate(texts) if t for a, b in candidates(t)]
    out: list[list] = [[] for _ in texts]
    for lo in range(0, len(spots), 50_000):
        part = spots[lo : lo + 50_000]
        x = np.array([features(texts[i][a:b], texts[i][max(0, a - CONTEXT) : a], texts[i][b : b + CONTEXT], lang) for i, a, b in part])
        for (i, a, b), p in zip(part, forest.predict(x), strict=True):
            if p >= THRESHOLD:
                if out[i] and a < out[i][-1][1]:  # overlapping findings are one
                    a, b, p = out[i][-1][0], max(b, out[i][-1][1]), max(p, out[i].pop()[2])
                out[i].append((a, b, float(p)))
    return out


def find_secrets(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, score, secret_sha256), one row for each finding.

    Positions count characters.  Overlapping findings are one.  Null and empty texts have no findings;
    repeated rows repeat theirs; ids pass through, null or not; other columns are ignored; an empty
    table gives none.
    """
    forest = train(vocab_path)

    def run(batches):
        lang = language(vocab_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = [(i, s, e, p, hashlib.sha256(t[s:e].encode()).hexdigest()) for i, t, found in zip(b.column(0).to_pylist(), texts, scan(texts, forest, lang), strict=True) for s, e, p in found]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()), strict=True)], names=["doc_id", "start", "end", "score", "secret_sha256"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(tidied(run), "doc_id long, start long, end long, score double, secret_sha256 string")


def redact(docs: DataFrame, vocab_path: str, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with every finding replaced by MASK and, where there is such a column, the number of
    characters brought up to date (null ones too, where something was found).  Null and empty texts
    stay as they are; all rows and columns stay, repeated ones too; an empty table stays empty."""
    forest = train(vocab_path)
    at = docs.columns.index(text_col)
    n_at = docs.columns.index(size_col) if size_col in docs.columns else None

    def run(batches):
        lang = language(vocab_path)
        for b in batches:
            texts, cols = b.column(at).to_pylist(), list(b.columns)
            sizes = cols[n_at].to_pylist() if n_at is not None else None
            for i, found in enumerate(scan(texts, forest, lang)):
                for s, e, _ in reversed(found):
                    texts[i] = texts[i][:s] + MASK + texts[i][e:]
                if found and sizes is not None:
                    sizes[i] = len(texts[i])
            cols[at] = pa.array(texts, pa.string())
            if sizes is not None:
                cols[n_at] = pa.array(sizes, b.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    fields = [T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema]
    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(tidied(run), T.StructType(fields))
