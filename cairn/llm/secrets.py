"""Secret scan: fixed patterns and a battery of randomness tests.

The patterns give the base spans. Beside them every run of 20 or more key characters is a
candidate: its encoding is inferred from its alphabet, and a chi-squared test of uniformity over
that alphabet, a runs test about its median and a test of the correlation between neighbours are
joined to one figure, the battery's p-value for "random symbols". Ordinary text fails it, so its
p-value under "ordinary text" is how often runs of text reach that figure: the battery is applied to
``DRAWS`` runs of the class' least length, drawn from the letters of the whole corpus, candidates
left out, that belong to the encoding. These p-values, of all candidates of an encoding and length class, go to a step-up rule that
holds the false-discovery rate at ``FDR``; shorter runs of text pass the battery more easily, so shorter
classes demand more. What the rule discovers is added with the kind ``random`` where no base span lies.
The likelihood ratio of uniform symbols to the corpus' letters is told beside it and decides nothing.

Offsets are code points, ends exclusive. A null text is empty and has no spans. Repeated rows are
each scanned, and count each in the discovery rate. A very long text is scanned whole; it takes some
times its own bytes in a worker. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import arrow_schema, materialise

#: Fixed patterns with their smallest accepted lengths, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Lengths from which a length class begins.
CLASSES = (20, 32, 48, 96)
FDR = 0.01
#: Runs of text that the battery is applied to, for each encoding and length class.
DRAWS = 40_000
#: Width of the bins of -log10 p in which discoveries are counted.
BIN = 0.25

HEX_FOLD = re.compile(r"[0-9a-fA-F]+")
BASE32 = re.compile(r"[A-Z2-7]+")
ALNUM = re.compile(r"[a-z0-9]+")
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
RANK = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns; leftmost matches of each kind, those too short left out."""
    found: list[tuple[int, int, str]] = []
    lower = text.lower()
    if any(k in lower for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def encoding_of(run: str) -> str | None:
    """Encoding that a run's characters allow, the smallest first; None for numbers and runs that are no key."""
    if run.isdigit():
        return None
    if HEX_FOLD.fullmatch(run) and (run == run.lower() or run == run.upper()):
        return "hex"
    if BASE32.fullmatch(run):
        return "base32"
    if ALNUM.fullmatch(run):
        return "alnum"
    return "base64"


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(run: str, encoding: str) -> float:
    """p-value of the three tests together under "symbols are independent and uniform"."""
    ranks = RANK[encoding]
    folded = run.lower() if encoding == "hex" else run.replace("-", "+").replace("_", "/") if encoding == "base64" else run
    x = [ranks[c] for c in folded if c in ranks]
    n, size = len(x), len(ranks)
    # uniformity: the cube root of chi-squared over its freedom is close to normal
    chi = sum(v * v for v in Counter(x).values()) * size / n - n
    free = size - 1
    uniform = 0.5 * math.erfc(((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)) / math.sqrt(2))
    # runs of the lower and upper half of the alphabet
    high = [v >= size / 2 for v in x]
    up, down = sum(high), n - sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 2 * up * down / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    run_p = _two_sided((runs - mean) / math.sqrt(spread)) if spread > 0 else 2.0 ** (1 - n)
    # correlation between neighbours
    centre = sum(x) / n
    power = sum((v - centre) ** 2 for v in x)
    serial = sum((a - centre) * (b - centre) for a, b in zip(x, x[1:])) / power if power else 1.0
    serial_p = _two_sided((serial + 1 / n) * math.sqrt(n))
    half = -sum(math.log(max(p, 1e-300)) for p in (uniform, run_p, serial_p))
    return math.exp(-half) * (1 + half + half * half / 2)


def battery(x: np.ndarray, size: int) -> np.ndarray:
    """``randomness`` of many runs of one length, as rows of ranks in an alphabet of so many symbols."""
    rows, n = x.shape
    erfc = np.vectorize(math.erfc, otypes=[float])
    counts = np.bincount((np.arange(rows)[:, None] * size + x).ravel(), minlength=rows * size).reshape(rows, size)
    chi, free = (counts.astype(float) ** 2).sum(1) * size / n - n, size - 1
    uniform = 0.5 * erfc((np.cbrt(chi / free) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)) / math.sqrt(2))
    high = x >= size / 2
    up = high.sum(1)
    mean = 2 * up * (n - up) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    some = spread > 0
    run_p = np.where(some, erfc(np.abs(runs - mean) / np.sqrt(np.where(some, spread, 1)) / math.sqrt(2)), 2.0 ** (1 - n))
    off = x - x.mean(1, keepdims=True)
    power = (off**2).sum(1)
    serial = np.where(power > 0, (off[:, 1:] * off[:, :-1]).sum(1) / np.where(power > 0, power, 1), 1.0)
    serial_p = erfc(np.abs((serial + 1 / n) * math.sqrt(n)) / math.sqrt(2))
    half = -sum(np.log(np.maximum(p, 1e-300)) for p in (uniform, run_p, serial_p))
    return np.exp(-half) * (1 + half + half * half / 2)


def null_figures(letters: dict[str, int]) -> dict[tuple[str, int], np.ndarray]:
    """Sorted figures that the battery gives runs of ordinary text, by encoding and length class: letters drawn as often as the corpus has them, one added to each."""
    out = {}
    for name, ranks in RANK.items():
        weight = np.ones(len(ranks))
        for c, n in letters.items():
            folded = {"-": "+", "_": "/"}.get(c, c) if name == "base64" else c.upper() if name == "base32" else c.lower()  # text may be all capitals
            if folded in ranks:
                weight[ranks[folded]] += n
        rng = np.random.Generator(np.random.PCG64(10))
        for k, length in enumerate(CLASSES):
            figures = []
            for _ in range(0, DRAWS, 5000):
                x = np.searchsorted(np.cumsum(weight / weight.sum()), rng.random((5000, length)), side="right").clip(0, len(ranks) - 1)
                figures.append(battery(x, len(ranks)))
            out[name, k] = np.sort(np.concatenate(figures))
    return out


def text_p(figure: float, null: np.ndarray) -> float:
    """How often ordinary text reaches a figure of the battery, the run itself counted."""
    return (1 + len(null) - int(np.searchsorted(null, figure, side="left"))) / (1 + len(null))


def evidence(run: str, encoding: str, frequency: dict[str, float]) -> float:
    """log10 of the likelihood ratio of uniform symbols to the corpus' letters.

    Case is free for the text where it is all one or only the first is a capital; else each letter
    pays for it.
    """
    body = run[1:]
    plain = body == body.lower() or run == run.upper()
    ratio = 0.0
    for c in run:
        text = frequency.get(c.lower(), 1e-6) * (1.0 if plain or not c.isalpha() else 0.5)
        ratio -= math.log10(len(ALPHABETS[encoding])) + math.log10(text)
    return ratio


def letter_counts(docs: DataFrame) -> dict[str, int]:
    """How often each key character stands in ordinary text: in all texts, candidates left out."""
    keys = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-")
    schema = "c string, n long"
    arrow = arrow_schema(schema)

    def count(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            for t in batch.column(0):
                text = t.as_py()
                if text:
                    total += np.bincount(np.frombuffer(CANDIDATE.sub("", text).encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array([chr(i) for i in range(128)]), pa.array([int(v) for v in total[:128]])], schema=arrow)

    found = docs.select("text").mapInArrow(count, schema).groupBy("c").agg(F.sum("n")).collect()
    return {c: n for c, n in found if c in keys}


def letter_frequencies(letters: dict[str, int]) -> dict[str, float]:
    """Share of each folded key character among those counted, one added to each."""
    found = Counter(dict.fromkeys("abcdefghijklmnopqrstuvwxyz0123456789+/_=-", 1))
    for c, n in letters.items():
        found[c.lower()] += n
    total = sum(found.values())
    return {c: n / total for c, n in found.items()}


def discoveries(bins: list[tuple[int, int, int]]) -> dict[int, int]:
    """Least bin of each class from which candidates are discoveries, of (class, bin, candidates)."""
    least = {}
    for cls in {c for c, _, _ in bins}:
        total, kept = sum(n for c, _, n in bins if c == cls), 0
        for bin_, n in sorted(((b, n) for c, b, n in bins if c == cls), reverse=True):
            kept += n
            if 10 ** (-bin_ * BIN) * total <= FDR * kept:  # step-up rule at the bin's largest p-value
                least[cls] = bin_
    return least


def _merged(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, in order."""
    starts, ends = [], []
    for a, b, _ in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _meets(taken: tuple[list[int], list[int]], start: int, end: int) -> bool:
    """Whether a span meets what is covered."""
    starts, ends = taken
    at = bisect_left(starts, end)
    return at > 0 and ends[at - 1] > start


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and those added, as arrays of (start, end, kind); the added ones' likelihood ratios in their order."""
    letters = letter_counts(docs)
    frequency = letter_frequencies(letters)
    nulls = docs.sparkSession.sparkContext.broadcast(null_figures(letters))  # DRAWS figures for each of 16 classes
    span = "array<struct<start:int,end:int,kind:string>>"
    schema = f"doc_id long, base {span}, candidates array<struct<start:int,end:int,cls:int,bin:int,ratio:double>>"
    arrow = arrow_schema(schema)

    def find(batches):
        for batch in batches:
            base, candidates = [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                spans = base_spans(text)
                base.append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
                own, taken = [], _merged(spans)
                for m in CANDIDATE.finditer(text):
                    a, b = m.span()
                    run = m[0].rstrip("=")
                    kind = encoding_of(run) if len(run) >= 20 and not _meets(taken, a, b) else None
                    if kind is None:
                        continue
                    k = sum(len(run) >= c for c in CLASSES) - 1
                    bin_ = int(-math.log10(text_p(randomness(run, kind), nulls.value[kind, k])) // BIN)
                    own.append({"start": a, "end": b, "cls": list(RANK).index(kind) * len(CLASSES) + k, "bin": bin_, "ratio": round(evidence(run, kind, frequency), 2)})
                candidates.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, arrow.field(1).type), pa.array(candidates, arrow.field(2).type)], schema=arrow)

    found = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, schema), "secret-spans")
    nulls.destroy()  # the candidates are written
    bins = found.select(F.explode("candidates").alias("c")).groupBy("c.cls", "c.bin").count().collect()  # 16 classes of some 20 bins
    least = discoveries([(b.cls, b.bin, b["count"]) for b in bins])
    if not least:
        return found.select("doc_id", "base", F.array().cast(span).alias("added"), F.array().cast("array<double>").alias("ratios"))
    passes = F.expr("filter(candidates, c -> " + " or ".join(f"(c.cls = {cls} and c.bin >= {b})" for cls, b in sorted(least.items())) + ")")
    added = F.transform(passes, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit("random").alias("kind"))).cast(span)
    return found.select("doc_id", "base", added.alias("added"), F.transform(passes, lambda c: c["ratio"]).alias("ratios"))


def secret_spans(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of each document."""
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    order = {k: i for i, k in enumerate(KINDS)}
    ranked = F.transform(
        F.concat("base", "added"),
        lambda x: F.struct(x["start"].alias("start"), F.element_at(F.create_map(*[F.lit(v) for kv in order.items() for v in kv]), x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")),
    )
    return scan(docs).select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(F.array_sort(ranked)).alias("spans"),
        F.size("added").cast("long").alias("n_random"),
        F.array_join(F.transform("ratios", lambda r: F.format_number(r, 2)), ",").alias("ratios"),
    )
