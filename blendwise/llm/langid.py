"""Language identification by interpolated Kneser-Ney character models.

Every language gets a character model of order ``ORDER`` over words (maximal runs of letters, lower-cased,
padded with start marks and an end mark).  Only the highest order counts occurrences; a lower order
counts in how many contexts a gram continues (Kneser-Ney), and each order's probability is mixed with the next
lower one's.  The counts cover every training document: tasks count the grams of their words, Spark
sums them and derives discounts, contexts and probabilities order by order with aggregates and joins.

The finished model is a few arrays: per order the sorted 64-bit hashes of the grams with a row of log
probabilities (one column per language), and the sorted hashes of the contexts with their back-off
weights.  It holds all grams and contexts, whatever their number; it is made on the driver and sent to the tasks whole, so
very large alphabets need the memory for it.

A text's score for a language is the mean negative log probability per character (end marks
included).  Pieces between white space and ASCII signs are scored once per task and remembered.  The prediction is the language with the
lowest cross-entropy.  It is rejected when that cross-entropy lies above both calibrated limits of the
language: mean + ``LIMIT`` standard deviations of its own texts of that length, and the middle between the ``OWN_TAIL`` quantile
of its own texts and the ``FOREIGN_TAIL`` quantile of texts of languages that are left out.  A text of a left-out
language has the lowest cross-entropy of all models but its own, and counts for the language that gives it.
The limits are fitted on every training row: Spark sums moments and counts values on a grid of ``GRID`` nats, whose
quantiles it takes, so that no more than the grid's points of a language meet in one task.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected; ties of the
cross-entropy go to the first language by name; with nothing to learn from every text is
``und``; rows with a null id or language are not learned from, and a null id is not held out; repeated rows are
scored alike; an empty table gives an empty result; extra columns pass through ``identify``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blendwise.llm.common import map_arrow, materialize, mix64, row_slices, table

ORDER = 4
GRID = 1e-4  # nats per character between values that the limits tell apart
LIMIT = 6.0
OWN_TAIL, FOREIGN_TAIL = 0.999, 0.05
FOREIGN_TEXTS = 20  # with fewer left-out texts of its own a language takes those of all others
EVIDENCE = 64  # characters whose evidence the reported score counts at most
# Memory bounds of a task: pieces and grams counted before they are passed on, pieces remembered, text bytes at a time.
FLUSH_WORDS, FLUSH_GRAMS = 50_000, 150_000
CACHE_WORDS, CACHE_CELLS = 400_000, 10_000_000
SLICE_BYTES = 1 << 20
START, END = "\x02", "\x03"
_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def pieces(text: str) -> list[bytes]:
    """UTF-8 of the lower-cased text between white space and other ASCII signs, which no word crosses: mostly words, found faster."""
    return text.lower().encode().translate(_SIGNS).split()


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def held_out(key: Column) -> Column:
    """The fold that is never learned from: crc32 of the id's text, remainder 2 of 4."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


# ---- counting ----

def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, Counter] = {}
    grams: dict[str, Counter] = {}

    def expand():
        for lang, counter in seen.items():
            into = grams.setdefault(lang, Counter())
            spoken = Counter()
            for piece, n in counter.items():
                for w in _WORD.findall(piece.decode()):
                    spoken[w] += n
            for w, n in spoken.items():
                padded = START * (ORDER - 1) + w + END
                for i in range(len(padded) - ORDER + 1):
                    into[padded[i:i + ORDER]] += n
        seen.clear()

    def emit():
        for lang, counter in grams.items():
            if counter:
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(counter), "g": list(counter),
                                                  "c": pa.array(counter.values(), pa.int64())})
        grams.clear()

    for b in row_slices(batches, "text", SLICE_BYTES):
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            seen.setdefault(lang, Counter()).update(pieces(text))
        if sum(map(len, seen.values())) > FLUSH_WORDS:
            expand()
            if sum(map(len, grams.values())) > FLUSH_GRAMS:
                yield from emit()
    expand()
    yield from emit()


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``(lang, g, c)``: occurrences of every gram of the highest order in all of ``labelled(lang, text)``."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return map_arrow(rows, _grams, "lang string, g string, c bigint").groupBy("lang", "g").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> tuple[list[DataFrame], list[DataFrame]]:
    """Per order 1..n: ``(lang, g, c, p)`` and ``(lang, h, back)``, the weight of the next lower order after context ``h``."""
    tables = {order: counts}
    for n in range(order - 1, 0, -1):  # in how many contexts does a gram continue?
        tables[n] = tables[n + 1].groupBy("lang", F.substring("g", 2, n).alias("g")).agg(F.count("*").alias("c"))
    letters = tables[1].select("g").distinct().count() + 1  # one number; one more for those never seen
    grams, contexts = [], []
    for n in range(1, order + 1):
        t = tables[n]
        ones, twos = F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))
        d = t.groupBy("lang").agg(F.least(F.greatest(F.coalesce(F.try_divide(ones, ones + 2 * twos), F.lit(0.5)), F.lit(0.1)), F.lit(0.95)).alias("d"))
        h = F.substring("g", 1, n - 1) if n > 1 else F.lit("")
        c = t.groupBy("lang", h.alias("h")).agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
        c = c.join(d, "lang").withColumn("back", F.col("d") * F.col("kinds") / F.col("total"))
        t = t.withColumn("h", h).join(c, ["lang", "h"])
        own = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")
        if n == 1:
            t = t.withColumn("p", own + F.col("back") / letters)
            c = c.withColumn("back", F.col("back") / letters)
        else:
            lower = grams[-1].select("lang", F.col("g").alias("s"), F.col("p").alias("lower"))
            t = t.withColumn("s", F.substring("g", 2, n - 1)).join(lower, ["lang", "s"]).withColumn("p", own + F.col("back") * F.col("lower"))
        grams.append(materialize(t.select("lang", "g", "c", "p"), f"grams{n}"))
        contexts.append(c.select("lang", "h", "back"))
    return grams, contexts


# ---- the model ----

# One odd multiplier per distance from the predicted letter (0: the letter itself).
_FACTORS = mix64(np.arange(1, ORDER + 1, dtype=np.uint64)) | np.uint64(1)


def _hash_codes(codes: np.ndarray, nearest: int = 0) -> np.ndarray:
    """Hash of each row of an (n, k) matrix of code points, the last one at distance ``nearest`` from the
    predicted letter: a sum over the letters, so that a gram's hash is its context's plus its letter's."""
    k = codes.shape[1]
    out = np.zeros(len(codes), np.uint64)
    for i in range(k):
        out += codes[:, i].astype(np.uint64) * _FACTORS[nearest + k - 1 - i]
    return out


def _codes(strings: list[str], k: int) -> np.ndarray:
    return np.array("".join(strings), dtype=f"U{max(1, k * len(strings))}").reshape(1).view(np.uint32)[: k * len(strings)].reshape(-1, k)


class Model:
    """Sorted hash arrays per order; ``langs`` names the columns."""

    def __init__(self, langs: list[str], grams: list[tuple], contexts: list[tuple], limits: dict | None = None):
        self.langs = langs
        self.limits = limits or {}
        column = {x: i for i, x in enumerate(langs)}
        self.keys, self.logp, self.ctx, self.back = [], [], [], []
        for n, (rows, ctx) in enumerate(zip(grams, contexts), 1):
            keys, values = self._table(rows, n, column, np.nan)
            self.keys.append(keys)
            self.logp.append(values)
            keys, values = self._table(ctx, n - 1, column, 0.0, 1) if n > 1 else (None, self._unseen(ctx, column))
            self.ctx.append(keys)
            self.back.append(values)

    @staticmethod
    def _table(rows, k, column, missing, nearest=0):
        langs, strings, values = rows
        h = _hash_codes(_codes(strings, k), nearest) if strings else np.zeros(0, np.uint64)
        keys, place = np.unique(h, return_inverse=True)
        out = np.full((len(keys) + 1, len(column)), missing, np.float32)  # the last row is for keys that are not there
        if strings:
            out[place, [column[x] for x in langs]] = np.log(np.array(values, np.float64))
        return keys, out

    @staticmethod
    def _unseen(rows, column):
        """Log probability of a letter that a language has never seen."""
        out = np.full(len(column), np.log(1e-6), np.float32)
        for lang, _, v in zip(*rows):
            out[column[lang]] = np.log(v)
        return out

    @staticmethod
    def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(x), np.int64)
        at = np.searchsorted(keys, x)
        at[at == len(keys)] = 0
        return np.where(keys[at] == x, at, len(keys))

    def score_words(self, ws: list[str]) -> np.ndarray:
        """(words, languages): log probability of each word with its end mark."""
        pad = START * (ORDER - 1)
        joined = "".join([pad + w + END for w in ws])
        codes = np.array(joined, dtype=f"U{len(joined)}").reshape(1).view(np.uint32)
        n = np.fromiter((len(w) + 1 for w in ws), np.int64, len(ws))
        ends = np.cumsum(n + ORDER - 1)
        first = ends - n
        # positions of the predicted letters
        place = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        letter = codes[place].astype(np.uint64) * _FACTORS[0]
        lp = self.logp[0][self._find(self.keys[0], letter)]
        lp = np.where(np.isnan(lp), self.back[0][None, :], lp)
        context = np.zeros(len(place), np.uint64)
        for k in range(2, ORDER + 1):
            context = context + codes[place - (k - 1)].astype(np.uint64) * _FACTORS[k - 1]
            p = self.logp[k - 1][self._find(self.keys[k - 1], context + letter)]
            missing = np.isnan(p)
            some = np.flatnonzero(missing.any(axis=1))  # only these need the context's weight
            back = self.back[k - 1][self._find(self.ctx[k - 1], context[some])]
            lower, lp = lp[some], p
            lp[some] = np.where(missing[some], back + lower, p[some])
        return np.add.reduceat(lp.astype(np.float64), np.concatenate(([0], np.cumsum(n)[:-1])), axis=0)


class Scorer:
    """Cross-entropies of texts; remembers the pieces that it has scored."""

    class Known(dict):
        """Number of each piece, in order of first sight; ``new`` are those without a score."""

        def __init__(self):
            self.new: list[bytes] = []

        def __missing__(self, piece: bytes) -> int:
            n = self[piece] = len(self)
            self.new.append(piece)
            return n

    def __init__(self, model: Model):
        self.model = model
        self.most = min(CACHE_WORDS, CACHE_CELLS // (len(model.langs) + 1))
        self._forget()

    def _forget(self) -> None:
        self.known = Scorer.Known()
        self.rows = np.zeros((1024, len(self.model.langs) + 1))

    def _learn(self) -> None:
        """Score the new pieces: sums over the words of each, and the characters counted."""
        used, new = len(self.known) - len(self.known.new), self.known.new
        if len(self.known) > len(self.rows):
            grown = np.zeros((max(len(self.known), 2 * len(self.rows)), self.rows.shape[1]))
            grown[:used] = self.rows[:used]
            self.rows = grown
        for i in range(0, len(new), 20_000):
            found = [_WORD.findall(x.decode()) for x in new[i:i + 20_000]]
            ws = [w for x in found for w in x]
            if ws:
                of = np.repeat(np.arange(len(found)), [len(x) for x in found])
                scores = np.column_stack([self.model.score_words(ws), [len(w) + 1 for w in ws]])
                first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                self.rows[used + i + of[first]] = np.add.reduceat(scores, first, axis=0)
        self.known.new = []

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) mean negative log probability per character, and the characters counted."""
        if len(self.known) > self.most:
            self._forget()
        found = [pieces(t) if t else [] for t in texts]
        n = np.fromiter(map(len, found), np.int64, len(found))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(found)), np.int64, int(n.sum()))
        self._learn()
        out = np.zeros((len(texts), self.rows.shape[1]))
        full = np.flatnonzero(n)
        if len(full):
            out[full] = np.add.reduceat(self.rows[at], np.concatenate(([0], np.cumsum(n)[:-1]))[full], axis=0)
        chars = out[:, -1]
        return -out[:, :-1] / np.maximum(chars, 1)[:, None], chars


def _collected(df: DataFrame, text: str, value: str) -> tuple[list, list, list]:
    p = df.select("lang", text, value).toPandas()
    return p["lang"].tolist(), p[text].tolist(), p[value].tolist()


def fit(labelled: DataFrame) -> Model | None:
    """Model of ``labelled(lang, text)``; None if there is nothing to learn from."""
    counts = materialize(gram_counts(labelled), "grams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    grams, contexts = kneser_ney(counts)
    model = Model(langs, [_collected(t, "g", "p") for t in grams], [_collected(c, "h", "back") for c in contexts])
    model.limits = _calibrate(labelled, model)
    return model


def _quantiles(df: DataFrame, value: Column, q: float) -> DataFrame:
    """``(lang, q, rows)``: the quantile of ``value`` over all rows of each language, and how many there are."""
    points = df.groupBy("lang", F.round(value / GRID).alias("at")).agg(F.count("*").alias("k"))
    return points.groupBy("lang").agg((F.percentile("at", F.lit(q), F.col("k")) * GRID).alias("q"), F.sum("k").alias("rows"))


def own_scores(labelled: DataFrame, model: Model) -> DataFrame:
    """``(lang, own, nearest, low, n)`` of every text with a word: cross-entropy for its language, the lowest one of the other
    languages and which that is, and the characters counted."""
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = shared.value.langs
        column = {x: i for i, x in enumerate(langs)}
        scorer = Scorer(shared.value)
        for b in row_slices(batches, "text", SLICE_BYTES):
            x, n = scorer.cross_entropy(b.column("text").to_pylist())
            some = np.flatnonzero(n)
            lang = b.column("lang").take(pa.array(some))
            x, mine, row = x[some], np.array([column[v] for v in lang.to_pylist()], np.int64), np.arange(len(some))
            own = x[row, mine]
            x[row, mine] = np.inf  # each text's language is left out
            nearest = x.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([lang, pa.array(own), pa.array([langs[i] for i in nearest], pa.string()),
                                              pa.array(x[row, nearest]), pa.array(n[some])], ["lang", "own", "nearest", "low", "n"])

    out = materialize(map_arrow(usable, score, "lang string, own double, nearest string, low double, n double"), "own-scores")
    shared.destroy()  # the prediction sends the model with its limits
    return out


def _calibrate(labelled: DataFrame, model: Model) -> dict[str, tuple[float, float, float, float]]:
    """Per language: mean cross-entropy of its own texts, variance per character and between long texts, and
    the limit set by texts of left-out languages (or by unseen letters, if there are none)."""
    spark = labelled.sparkSession
    p = own_scores(labelled, model)
    n = F.col("n")
    means = p.groupBy("lang").agg((F.sum(F.col("own") * n) / F.sum("n")).alias("mean")).collect()  # one row per language, as below
    if not means:
        return {}
    d = p.join(F.broadcast(spark.createDataFrame(means, "lang string, mean double")), "lang")
    d = d.withColumn("off", F.pow(F.col("own") - F.col("mean"), 2)).withColumn("w", n / (1 + n / 200))
    w, off = F.col("w"), F.col("off")
    # off ~ per_char / n + between: the sums of weighted least squares
    sums = d.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(w / n / n), F.sum(w / n), F.sum(w), F.sum(w * off / n), F.sum(w * off))
    sums = {r[0]: r[1:] for r in sums.collect()}
    middle = {r["lang"]: np.exp(r["q"]) for r in _quantiles(d, F.log(F.greatest(off * n, F.lit(1e-12))), 0.5).collect()}
    tail = {r["lang"]: r["q"] for r in _quantiles(p, F.col("own"), OWN_TAIL).collect()}
    away = p.filter("nearest <> lang").select("lang", "nearest", "low")
    foreign = {r["lang"]: r["q"] for r in _quantiles(away.select(F.col("nearest").alias("lang"), "low"), F.col("low"), FOREIGN_TAIL)
               .filter(F.col("rows") >= FOREIGN_TEXTS).collect()}
    few = [(r["lang"],) for r in means if r["lang"] not in foreign]
    if few:
        points = away.groupBy(F.col("lang").alias("other"), F.round(F.col("low") / GRID).alias("at")).agg(F.count("*").alias("k"))
        j = points.join(F.broadcast(spark.createDataFrame(few, "lang string")), F.col("lang") != F.col("other"))
        j = j.groupBy("lang").agg((F.percentile("at", F.lit(FOREIGN_TAIL), F.col("k")) * GRID).alias("q"))
        foreign.update({r["lang"]: r["q"] for r in j.collect()})
    out = {}
    for lang, mean in means:
        rows, *s = sums[lang]
        # both kept positive
        per_char, between = np.linalg.lstsq(np.array([[s[0], s[1]], [s[1], s[2]]]), np.array(s[3:]), rcond=None)[0] if rows > 2 else (1.0, 0.0)
        far = foreign.get(lang, -float(model.back[0][model.langs.index(lang)]))
        out[lang] = (mean, max(float(per_char), float(middle[lang]), 1e-3), max(float(between), 1e-3), (tail[lang] + far) / 2)
    return out


def identify(df: DataFrame, model: Model | None, text: str = "text", out: tuple[str, str, str, str] = (
        "lang_pred", "score", "cross_entropy", "rejected")) -> DataFrame:
    """``df`` plus predicted language, confidence 0 to 1, cross-entropy (nats per character) and whether it is rejected."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(df.schema.fields + [T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType()),
                                              T.StructField(out[2], T.DoubleType()), T.StructField(out[3], T.BooleanType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model) if model else None
        for b in row_slices(batches, text, SLICE_BYTES):
            texts = b.column(text).to_pylist()
            pred, score, ce, no = [], [], [], []
            if scorer:
                x, n = scorer.cross_entropy(texts)
                best = x.argmin(axis=1)
                low = x[np.arange(len(x)), best]
                sure = 1 / np.exp(-(x - low[:, None]) * np.minimum(n, EVIDENCE)[:, None]).sum(axis=1)
            for i, t in enumerate(texts):
                if not scorer or not has_letter(t):
                    pred.append("und")
                    score.append(0.0)
                    ce.append(None)
                    no.append(True)
                    continue
                lang = model.langs[best[i]]
                mean, per_char, between, far = model.limits.get(lang, (np.inf, 1.0, 1.0, np.inf))
                pred.append(lang)
                score.append(float(sure[i]))
                ce.append(float(low[i]))
                no.append(bool(low[i] > max(far, mean + LIMIT * np.sqrt(per_char / n[i] + between))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(ce, pa.float64()), pa.array(no, pa.bool_())], [f.name for f in schema])

    return map_arrow(df, predict, schema)


def fit_on_documents(docs: DataFrame, key: str = "doc_id") -> Model | None:
    """Model of the documents that are not held out."""
    fold = F.crc32(F.col(key).cast("string")) % 4
    return fit(docs.filter(fold != 2).select("lang", "text"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_on_documents(docs)
    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(d, model).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
