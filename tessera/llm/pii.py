"""Personal data: fixed patterns plus a semi-Markov conditional random field.

The patterns (email, ip, card, phone) always hold. Around every digit, @, cue word
and spelt-out address of a text a window of whole tokens is cut, and the random field
labels its segmentation:
each segment is one token of nothing or up to MAX_TOKENS tokens of one entity
type, scored by features of the whole span. Bounded-entity dynamic programming
finds the best boundaries and types together. Weights are fitted by conditional
likelihood on a bounded number of windows, whose labels are the pattern matches
and a few seed patterns for secrets and spelt-out addresses; features don't name the
patterns, so spans the patterns miss can be found. A seed's match is added too where
the field leaves it or a part of it. Spans that overlap a pattern match are not added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "secret"]
MAX_TOKENS = 8
TRAIN_WINDOWS = 1200      # windows the weights are fitted on, at most
TRAIN_DOCS = 4000         # documents they are taken from, at most,
TRAIN_CHARS = 20_000      # none longer than this,
SAMPLE_DOCS = 40_000      # out of about so many documents of lowest text hash
EPOCHS, RATE, DECAY = 8, 0.3, 1e-4

# Fixed patterns. Possessive digits and the look-behind change no match, only the time taken.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SEEDS = [("secret", re.compile(r"\bAKIA[0-9A-Z]{16}\b")),
          ("secret", re.compile(r"(?i:token|password|passwd|secret|api_?key)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_/+-]{8,})")),
          ("email", re.compile(r"(?i)(?<![\w.%+-])[a-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[a-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?[a-z0-9-]{2,63})+")),
          ("email", re.compile(r"(?i)(?<![\w.%+-])[a-z0-9._%+-]{1,64} at (?:[a-z0-9-]{1,63} dot )+"
                               r"(?:com|org|net|edu|gov|mil|info|biz|io|dev|co dot uk|uk|de|fr|nl|eu|ca|au|jp|cn|ru|br)\b"))]
# Where a window is cut: digits, @, and, in texts with one of the words, the words of the cues and seeds. Java reads it alike.
_WORDS = ("token", "passw", "secret", "key", "pwd", "credential", "akia", "dot")
_PLAIN = re.compile(r"[0-9@]+")
_ANCHOR = re.compile(r"[0-9@]+|(?i:token|passw|secret|key|pwd|credential|akia|[\[( ]dot[\]) ])")
MAX_CHARS = 120           # of a span
_RUN = re.compile(r"[A-Za-z0-9_%+@.-]*")
_TOKEN = re.compile(r"[A-Za-z0-9_%+@.-]*[A-Za-z0-9]|\S")
_CUES = re.compile(r"(?i)token|passw|secret|key|pwd|credential")
_CALLS = re.compile(r"(?i)phone|tel|call|fax|mobile|mail|contact")
_MAILS = re.compile(r"[^@\s]+@[^@\s]+\.[^@\s.]+")
_SPELT = re.compile(r"(?i)\S+ ?[\[(]?at[\])]? ?\S+ ?[\[(]?dot[\])]? ?\S+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """EMAIL's matches in linear time: at each @ the longest local part behind, the domain ahead."""
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done:                     # back over the local part, a stretch at a time
            some = text[max(done, lo - 64): lo]
            back = len(_LOCAL.match(some[::-1])[0])
            lo -= back
            if back < len(some):
                break
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            yield lo, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) pattern matches by start, then kind as listed; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _edge(text: str, at: int, step: int) -> int:
    """``at`` moved to the end of the token it falls in, or so far that what is left of it is too long for a span."""
    some = text[at: at + MAX_CHARS + 1] if step > 0 else text[max(0, at - MAX_CHARS - 1): at][::-1]
    return at + step * len(_RUN.match(some)[0])


def anchors(text: str) -> re.Pattern:
    """The pattern of the text's anchors; a plain one where only digits and @ can be any."""
    low = text.lower()
    return _ANCHOR if any(x in low for x in _WORDS) else _PLAIN


def windows(text: str, before: int = 48, after: int = 24, gap: int = 48) -> Iterator[list[tuple[int, int]]]:
    """Token spans of each stretch of text around anchors, tokens at its ends whole."""
    lo = hi = None
    for m in anchors(text).finditer(text):
        start, end = max(0, m.start() - before), min(len(text), m.end() + after)
        if lo is None:
            lo = start
        elif start - hi > gap and _edge(text, start, -1) > _edge(text, hi, 1):
            yield _tokens(text, lo, hi)
            lo = start
        hi = end
    if lo is not None:
        yield _tokens(text, lo, hi)


def _tokens(text, lo, hi):
    return [m.span() for m in _TOKEN.finditer(text, _edge(text, lo, -1), _edge(text, hi, 1))]


N_FEATURES, _LUHN = 27, 10


def _features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[float]:
    """Features of the span of tokens i to j (exclusive)."""
    a, b = tokens[i][0], tokens[j - 1][1]
    s = text[a:b]
    d = _digits(s)
    solid = s.replace(" ", "")
    left = text[max(0, a - 24):a]
    groups = re.findall(r"[0-9]+", s)
    alone = " " not in s
    letters = any(c.isalpha() for c in s)
    parts = s.split(".")
    n = len(d)
    return [
        1.0, (j - i) / MAX_TOKENS,
        float("@" in s), float(bool(_MAILS.fullmatch(s))), float(bool(_SPELT.fullmatch(s))),
        float(9 <= n <= 11), float(12 <= n <= 19), float(n == 0), float(0 < n < 7 and len(s) < 12),
        float(n >= 0.6 * len(solid)), float(n >= 12 and luhn(d)),
        float(len(parts) == 4 and all(p.isascii() and p.isdigit() and _small(p) for p in parts)),
        float(s[0] == "+"), float("(" in s and ")" in s), float([len(g) for g in groups[-3:]] == [3, 3, 4]),
        float(alone and letters and n > 0 and len(s) >= 16), float(len(s) >= 12 and all(c in "0123456789abcdef" for c in s)),
        float(alone and len(s) >= 16 and s.isalnum() and s.upper() == s and letters),
        float(bool(_CUES.search(left))), float(bool(_CALLS.search(left))),
        float(not s[0].isalnum() and s[0] not in "+("), float(not s[-1].isalnum()),
        float(a > 0 and not text[a - 1].isspace() and text[a - 1] not in "\"'(<[=:,;"),
        float(b < len(text) and text[b].isalnum()), float(bool(re.search(r"\s\s|\n", s))),
        float(letters and n == 0), float(n >= 12 and not luhn(d)),
    ]


def _tensor(text: str, tokens: list[tuple[int, int]]) -> np.ndarray:
    """Features by end token, length - 1 and feature; spans that begin before the window are zero."""
    out = np.zeros((len(tokens), MAX_TOKENS, N_FEATURES))
    for j in range(1, len(tokens) + 1):
        for n in range(1, min(MAX_TOKENS, j) + 1):
            a, b = tokens[j - n][0], tokens[j - 1][1]
            if b - a <= MAX_CHARS:
                out[j - 1, n - 1] = _features(text, tokens, j - n, j)
    return out


def _scores(tensor: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores by end token, length - 1 and kind. No candidates: spans out of bounds, cards that fail Luhn."""
    s = tensor @ weights.T
    s[tensor[:, :, 0] == 0] = -np.inf
    s[tensor[:, :, _LUHN] == 0, KINDS.index("card")] = -np.inf
    return s


def _log_sum(x: np.ndarray) -> float:
    top = x.max()
    return top + np.log(np.exp(x - top).sum()) if np.isfinite(top) else top


def decode(scores: np.ndarray) -> list[tuple[int, int, int]]:
    """(first token, end token, kind) of the best segmentation; a token of nothing scores 0."""
    n = len(scores)
    best, back = np.zeros(n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        reach = min(MAX_TOKENS, j)
        cand = best[j - np.arange(1, reach + 1)][:, None] + scores[j - 1, :reach]
        k = int(np.argmax(cand))
        if cand.flat[k] > best[j]:
            best[j], back[j] = cand.flat[k], (j - 1 - k // scores.shape[2], k % scores.shape[2])
    out, j = [], n
    while j:
        if back[j]:
            out.append((back[j][0], j, back[j][1]))
            j = back[j][0]
        else:
            j -= 1
    return out[::-1]


def expected(scores: np.ndarray) -> tuple[float, np.ndarray]:
    """Log partition function over all segmentations, and each segment's probability."""
    n = len(scores)
    fore, rear = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    fore[0] = rear[n] = 0.0
    for j in range(1, n + 1):
        reach = min(MAX_TOKENS, j)
        fore[j] = _log_sum(np.concatenate([[fore[j - 1]], (fore[j - np.arange(1, reach + 1)][:, None]
                                                           + scores[j - 1, :reach]).ravel()]))
    for i in range(n - 1, -1, -1):
        parts = [np.array([rear[i + 1]])] + [scores[i + m, m] + rear[i + m + 1] for m in range(min(MAX_TOKENS, n - i))]
        rear[i] = _log_sum(np.concatenate(parts))
    p = np.zeros_like(scores)
    for j in range(1, n + 1):
        reach = min(MAX_TOKENS, j)
        p[j - 1, :reach] = np.exp(fore[j - np.arange(1, reach + 1)][:, None] + scores[j - 1, :reach] + rear[j] - fore[n])
    return float(fore[n]), p


def _seeds(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the seed patterns' matches."""
    return [(kind, *m.span(m.lastindex or 0)) for kind, pattern in _SEEDS for m in pattern.finditer(text)]


def _silver(text: str) -> list[tuple[str, int, int]]:
    return base_spans(text) + _seeds(text)


def fit(texts: list[str]) -> np.ndarray:
    """Weights (kind x feature) by stochastic gradient ascent of the conditional likelihood.

    Windows whose silver spans overlap or don't fall on token bounds are left out.
    Without any window the weights let nothing be an entity.
    """
    train = []
    for text in texts:
        silver = _silver(text)
        for tokens in windows(text):
            if len(train) >= TRAIN_WINDOWS or not tokens or len(tokens) > 200:
                continue
            starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
            own = [(starts.get(a), ends.get(b), KINDS.index(k)) for k, a, b in silver if a < tokens[-1][1] and b > tokens[0][0]]
            if any(i is None or j is None or not 0 < j - i <= MAX_TOKENS for i, j, _ in own):
                continue
            held = sorted((i, j) for i, j, _ in own)
            if any(x[1] > y[0] for x, y in zip(held, held[1:])):
                continue
            train.append((_tensor(text, tokens), own))
    weights = np.zeros((len(KINDS), N_FEATURES))
    weights[:, 0] = -4.0
    grads = np.full_like(weights, 1e-6)
    for _ in range(EPOCHS):
        for tensor, own in train:
            _, p = expected(_scores(tensor, weights))
            step = -np.einsum("jnk,jnf->kf", p, tensor) - DECAY * weights
            for i, j, k in own:
                step[k] += tensor[j - 1, j - i - 1]
            grads += step * step
            weights += RATE * step / np.sqrt(grads)
    return weights


def added_spans(text: str, weights: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the random field that touch no pattern match, and what the seeds match beyond them."""
    out = []
    for tokens in windows(text):
        if tokens:
            scores = _scores(_tensor(text, tokens), weights)
            for i, j, k in decode(scores):
                a, b = tokens[i][0], tokens[j - 1][1]
                if not any(x < b and a < y for _, x, y in base):
                    out.append((KINDS[k], a, b))
    for k, a, b in _seeds(text) if anchors(text) is _ANCHOR else []:
        if not any(x < b and a < y for _, x, y in base) and not any(x <= a and b <= y for _, x, y in out):
            out = [s for s in out if s[2] <= a or b <= s[1] or s[1] < a or b < s[2]] + [(k, a, b)]
    return out


def find(text: str | None, weights: np.ndarray) -> tuple[list, list]:
    """(pattern matches, added spans) of a text; none for null."""
    if not text or not anchors(text).search(text):
        return [], []
    base = base_spans(text)
    return base, added_spans(text, weights, base)


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def train(docs: DataFrame, text_col: str = "text", max_docs: int = TRAIN_DOCS) -> np.ndarray:
    """Weights fitted on at most ``max_docs`` texts with an anchor and at most TRAIN_CHARS
    characters, taken from SAMPLE_DOCS documents or a few more, lowest text hash first."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    some = docs.select(docs[text_col].cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    some = some.where((F.col("h") <= F.lit(round(-2**63 + share * (2**64 - 1)))) & (F.length("t") <= TRAIN_CHARS)) if share < 1 \
        else some.where(F.length("t") <= TRAIN_CHARS)
    rows = some.where(F.col("t").rlike(_ANCHOR.pattern)).dropDuplicates(["h"]).orderBy("h").limit(max_docs).collect()
    return fit([r["t"] for r in rows])


def spans(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base and added (each a list of kind, start, end).

    Null and empty texts have none. Repeated rows stay, ids may be null, an empty
    table gives no rows; other columns are not read. Memory is bounded by a batch
    and the longest text.
    """
    one = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [find(t, weights) for t in b.column(1).to_pylist()]
            cols = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in g[k]] for g in got], one) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "base", "added"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        run, "doc_id long, base array<struct<kind:string,start:long,end:long>>, added array<struct<kind:string,start:long,end:long>>")


def hidden(text: str | None, weights: np.ndarray) -> str | None:
    """The text with every span replaced by its kind in brackets; spans that overlap go as one."""
    base, added = find(text, weights)
    if not base and not added:
        return text
    out, at = [], 0
    for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """The documents with personal data in ``text_col`` replaced; n_chars, if there, follows the text.

    Null texts stay null and empty ones empty, whole texts are searched, overlapping spans are
    hidden once. Rows are never dropped or merged, so repeated rows and null ids stay; all other
    columns stay, whatever their names. An empty table gives no rows.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([hidden(t, weights) for t in b.column(place).to_pylist()], b.schema.field(place).type)
            yield b.set_column(place, b.schema.field(place), texts)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts of pattern matches, their digest, and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
            for base, added in zip(b.column("base").to_pylist(), b.column("added").to_pylist()):
                base, added = [[(s["kind"], s["start"], s["end"]) for s in x] for x in (base, added)]
                for k in KINDS[:4]:
                    rows[f"n_{k}"].append(sum(s[0] == k for s in base))
                rows["base_sha256"].append(hashlib.sha256(_listed(base).encode()).hexdigest())
                rows["spans"].append(_listed(base + added))
                rows["n_added"].append(len(added))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[
                pa.array(v, pa.string() if c in ("base_sha256", "spans") else pa.int64()) for c, v in rows.items()]],
                names=["doc_id", *rows])

    return spans(docs, weights).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                                "base_sha256 string, spans string, n_added long")


QUERIES = {"op4_pii": op4_pii}
ORACLES: dict[str, str] = {}
