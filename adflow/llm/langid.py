"""Language identification: averaged hashed subword embeddings with a linear
softmax, trained by stochastic gradient descent in numpy, with calibrated
rejection.

Features: the text is lower-cased, everything but letters becomes a word border,
and all character n-grams of 1 to 4 inside ``<word>`` (borders count as a
character) are hashed to buckets. A document is the average of its n-gram
embeddings; the softmax has no bias, so a text of unseen n-grams gets equal
scores for all languages. Whole texts are read, in bounded pieces.

Training: a bounded sample of labelled rows (``sample_per_lang`` expected rows a
language, chosen by a hash of the id) is reduced to bucket counts on the
executors and fitted on the driver, whose memory use is bounded by the sample
and the number of buckets. A fourth of the sample is held back to calibrate: a
temperature is fitted to the scores, and the rejection threshold is the lowest
confidence at which the accepted rows reach ``target_accuracy``, at least even odds,
but never so high that more than ``most_lost`` of the held-back rows whose label the
model confirms would go: wrong labels must not cost clean documents. Prediction needs only the product of both matrices, one row of
scores a bucket, which every task gets (buckets x languages floats).

Defined results: a null text, or one without letters, is ``und`` with score 0 and
is rejected. With no labelled row at all every text is ``und``. Of languages with the
same score the first by code point is told. Repeated rows and rows of one id are
predicted one by one; an empty table gives an empty result. Columns are taken by name
into fresh ones, so that other columns cannot clash.

Driver: the sample is bounded in rows; a row is two numbers for each bucket its text
holds, so the worst case is ``sample_per_lang`` x languages x ``BUCKETS`` x 8 bytes (0.8 GB
a language), and a few kilobytes a row on ordinary texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_row, slices

UNDETERMINED = "und"
BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
#: Characters handled at once; longer texts are read in pieces.
PIECE = 1 << 18


@dataclass(frozen=True)
class LanguageModel:
    """``scores[bucket, language]``, the fitted temperature and the rejection threshold."""

    languages: tuple[str, ...]
    scores: object
    temperature: float
    threshold: float


# -------------------------------------------------------------------- features

_LETTER = None


def _letters():
    """Boolean by code point: is it a letter? Built once in each worker."""
    global _LETTER
    if _LETTER is None:
        import numpy as np

        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def _codes(text: str):
    """Code points of the lower-cased text, 0 for everything but letters, runs of
    0 reduced to one, with a 0 at both ends."""
    import numpy as np

    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = np.where(_letters()[code], code, 0)
    code = np.concatenate([np.zeros(1, np.uint32), code.astype(np.uint32), np.zeros(1, np.uint32)])
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    return code[keep]


def _grams(code) -> Iterator:
    """(first position, bucket) of every n-gram with letters inside."""
    import numpy as np

    code = code.astype(np.uint64)
    letter = code != 0
    key = np.zeros(len(code), dtype=np.uint64)
    inner = np.ones(len(code), dtype=bool)
    for n in range(1, max(GRAMS) + 1):
        size = len(code) - n + 1
        if size <= 0:
            return
        key = key[:size] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1:]
        if n >= 3:  # the characters between the first and the last are letters
            inner = inner[:size] & letter[n - 2: n - 2 + size]
        ok = inner[:size] & (letter[:size] | letter[n - 1:]) if n > 1 else letter
        if n in GRAMS:
            at = np.flatnonzero(ok)
            mixed = (key[at] ^ (key[at] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield at, (mixed >> np.uint64(64 - 16)).astype(np.int64) % BUCKETS


def _pieces(text: str | None) -> Iterator[str]:
    """The text in pieces cut at white space, so that no word is split."""
    text = text or ""
    while len(text) > PIECE:
        cut = max(text.rfind(" ", 0, PIECE), text.rfind("\n", 0, PIECE))
        cut = cut if cut > 0 else PIECE
        yield text[:cut]
        text = text[cut:]
    yield text


def bucket_counts(text: str | None):
    """(buckets, counts) of one text."""
    import numpy as np

    total = np.zeros(BUCKETS, dtype=np.int64)
    for piece in _pieces(text):
        for _, bucket in _grams(_codes(piece)):
            total += np.bincount(bucket, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.int32)


def _score_batch(texts: list[str | None], scores):
    """(summed scores by language, number of n-grams) of each text."""
    import numpy as np

    out = np.zeros((len(texts), scores.shape[1]))
    grams = np.zeros(len(texts), dtype=np.int64)
    held: list[tuple[int, str]] = []
    size = 0

    def flush():
        codes = [_codes(piece) for _, piece in held]
        owner = np.repeat([d for d, _ in held], [len(c) for c in codes])
        flat = np.concatenate(codes)
        # The 0 at both ends of every text keeps n-grams from crossing texts.
        for at, bucket in _grams(flat):
            if not len(at):
                continue
            doc = owner[at]
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            np.add.at(out, doc[first], np.add.reduceat(scores[bucket], first, axis=0))
            np.add.at(grams, doc[first], np.diff(np.r_[first, len(doc)]))
        held.clear()

    for d, text in enumerate(texts):
        for piece in _pieces(text):
            held.append((d, piece))
            size += len(piece)
            if size >= PIECE:
                flush()
                size = 0
    if held:
        flush()
    return out, grams


# -------------------------------------------------------------------- training

def _softmax(z):
    import numpy as np

    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple], dim: int = 16, epochs: int = 8, rate: float = 0.5, batch: int = 16,
        seed: int = 7, target_accuracy: float = 0.98, least_odds: float = 0.5,
        most_lost: float = 0.01) -> LanguageModel:
    """Fit on ``rows`` of (key, language, buckets, counts). The key orders the
    rows and picks the calibration fourth, so reruns agree."""
    import numpy as np

    rows = sorted(rows, key=lambda r: (str(r[0]), r[1], len(r[2])))
    rows = [r for r in rows if len(r[2])]
    languages = tuple(sorted({r[1] for r in rows}))
    if not languages:
        return LanguageModel((), np.zeros((BUCKETS, 0), dtype=np.float32), 1.0, 1.0)
    y_of = {lang: i for i, lang in enumerate(languages)}
    held = [r for r in rows if zlib.crc32(f"calibrate {r[0]}".encode()) % 4 == 0]
    train = [r for r in rows if zlib.crc32(f"calibrate {r[0]}".encode()) % 4 != 0]
    known = {r[1] for r in train}
    train += [r for r in held if r[1] not in known]  # a language seen only in the held-back rows
    data = [(np.asarray(r[2]), np.asarray(r[3], dtype=np.float64) / np.sum(r[3]), y_of[r[1]]) for r in train]
    rng = np.random.default_rng(seed)
    k = len(languages)
    embed = np.zeros((BUCKETS, dim))
    soft = rng.normal(0, 1 / np.sqrt(dim), (dim, k))
    seen = np.bincount([y for _, _, y in data], minlength=k)
    weight = len(data) / (k * np.maximum(seen, 1))  # every language counts alike
    steps = -(-len(data) // batch) * epochs
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            pick = [data[i] for i in order[at:at + batch]]
            speed = rate * (1 - step / steps)
            step += 1
            hidden = np.stack([w @ embed[b] for b, w, _ in pick])
            slope = _softmax(hidden @ soft)
            slope[np.arange(len(pick)), [y for _, _, y in pick]] -= 1
            slope *= weight[[y for _, _, y in pick]][:, None]
            back = slope @ soft.T
            soft -= speed * hidden.T @ slope / len(pick)
            for (b, w, _), g in zip(pick, back):
                # The average spreads a step over all n-grams of a text; scale it back up.
                embed[b] -= speed * 20 * w[:, None] * g[None, :]
    scores = embed @ soft
    temperature, threshold = _calibrate(held or train, scores, y_of, target_accuracy, least_odds, most_lost)
    return LanguageModel(languages, scores.astype(np.float32), temperature, threshold)


def _calibrate(rows, scores, y_of, target: float, least: float, most_lost: float) -> tuple[float, float]:
    """Temperature of lowest log loss on the held-back rows, and the lowest
    confidence, not under ``least``, from which accepted rows reach ``target``, as far
    as at most ``most_lost`` of the rightly told rows lie below it."""
    import numpy as np

    z = np.stack([(np.asarray(c) / np.sum(c)) @ scores[np.asarray(b)] for _, _, b, c in rows])
    y = np.array([y_of[r[1]] for r in rows])
    grid = np.exp(np.linspace(np.log(0.25), np.log(20), 121))
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-best, kind="stable")
    accuracy = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(accuracy >= target)
    reached = best[order][good[-1]] if len(good) else 1.0
    wanted = least if len(good) == len(y) or reached < least else reached
    sure = np.sort(best[right])
    return temperature, float(min(wanted, sure[int(most_lost * len(sure))]) if len(sure) else least)


def _hash_unit(column: Column) -> Column:
    """Uniform in [0, 1) from the value itself, the same on every run."""
    return F.pmod(F.xxhash64(column.cast("string"), F.lit("language sample")), F.lit(1 << 30)) / F.lit(1 << 30)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          sample_per_lang: int = 1500, **options) -> LanguageModel:
    """Fit a model on the labelled rows of ``docs`` (those with a language and a
    text). The sample holds about ``sample_per_lang`` rows a language."""
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}  # one row a language
    if not counts:
        return fit([], **options)
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, sample_per_lang / n))])
    sample = labelled.filter(_hash_unit(F.col(key)) < share[F.col(lang)])

    def run(batches):
        import pyarrow as pa

        for b in (part for whole in batches for part in slices(whole)):
            found = [bucket_counts(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x for x, _ in found], pa.list_(pa.int32())),
                 pa.array([x for _, x in found], pa.list_(pa.int32()))], names=["key", "lang", "buckets", "counts"])

    schema = "key string, lang string, buckets array<int>, counts array<int>"
    rows = sample.select(F.col(key).cast("string"), F.col(lang).cast("string"), F.col(text)).mapInArrow(run, schema)
    table = rows.toArrow()  # bounded: sample_per_lang rows a language, at most BUCKETS numbers each
    return fit(list(zip(table["key"].to_pylist(), table["lang"].to_pylist(),
                        [x.values.to_numpy() for x in table["buckets"]],
                        [x.values.to_numpy() for x in table["counts"]])), **options)


# ------------------------------------------------------------------ prediction

PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("rejected", T.BooleanType())])


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The columns of ``docs`` in a struct ``row``, and lang_pred, score (calibrated
    probability of that language) and rejected."""
    schema = T.StructType([T.StructField("row", docs.schema), *PREDICTION.fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = shared.value
        for b in (part for whole in batches for part in slices(whole)):
            summed, grams = _score_batch(b.column(1).to_pylist(), m.scores)
            known = (grams > 0) & bool(m.languages)
            best = np.zeros(len(grams), dtype=np.int64)
            p = np.zeros(len(grams))
            if known.any():
                probability = _softmax(summed[known] / grams[known][:, None] / m.temperature)
                best[known], p[known] = probability.argmax(axis=1), probability.max(axis=1)
            names = [m.languages[i] if ok else UNDETERMINED for i, ok in zip(best, known)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(names, pa.string()), pa.array(p, pa.float64()),
                 pa.array(~known | (p < m.threshold), pa.bool_())], names=schema.names)

    return docs.select(as_row(docs), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that never trains: crc32 of the id's text, modulo 3, is 1. A null
    id belongs to no fold and never trains either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of ``docs``; the
    model is trained on the rows outside the held-out fold."""
    found = predict(docs.select("doc_id", "text"), train(_labelled(docs), **options))
    return found.select("row.doc_id", "lang_pred", "score", "rejected").select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with exactly its columns."""
    return predict(docs, train(_labelled(docs), **options)).filter(~F.col("rejected")).select("row.*")
