"""Language identification by hierarchical discrimination.

Features are hashed byte trigrams of the whole text: letters folded to lower case, anything but letters
one space. First the language family is predicted by multinomial naive Bayes over the families' trigram
counts; then one-versus-one linear support vector machines, trained by sub-gradient steps on the hinge
loss, vote on the language within it. The score is the family's posterior times the winner's mean
logistic margin.

The score weighs the learned languages against each other and says nothing of a text in none of them. For
that, calibrate() finds the usual mean log-probability of a trigram under the language told, and how far
held-out texts of all lengths fall below it; identify() marks as foreign what falls ``REACH`` times as far and ``SLACK``
over the number of held-out texts more.

Learned from every labelled row that is not held out (learn()): trigrams are counted over all of them, and each two languages of a family
are told apart by the mean of machines over parts of their rows. A part has some ``PER_LANG`` rows of the larger language and ``LEAST`` of the smaller; every
row is in one part at least, a small language's rows in several. calibrate() looks at every held-out row told as labelled, in steps of 1e-4.
train() is a quick model of a bounded sample, no query's: at most ``PER_LANG`` rows a language and ``SAMPLE`` in all, one of each at least, chosen by a hash.
Everything is predicted; the model takes 64 kB a language, whatever the corpus holds. doc_id, lang and source are
never inputs of a prediction. Learning is deterministic. Counts are dense for ``ROWS`` texts at a time, so memory follows
the bytes of texts, not their number; a text of any length is taken whole.
In the family's posterior a text counts as at most ``WEIGHT`` trigrams, which only tempers the score: the family
told is the same for any weight.

Nulls, empty texts and texts without a letter are ``und`` with score 0; so is everything if there is no
labelled row. A null doc_id is not held out. Equal texts get equal predictions. Columns named like an output
are replaced; all others play no part and pass through untouched, whatever their names. An empty table gives an
empty one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobath.llm import near_dedup as N
from isobath.llm.shared import materialise, shielded, table

BITS = 12
PER_LANG = 300
SAMPLE = 6_000
# Rows of the smaller language in a part at least, as far as it has them; parts that one group trains.
LEAST, PARTS = 32, 8
ROWS = 128
# The trigrams of a text are not independent: in the family's posterior a text weighs no more than so many.
WEIGHT = 200.0
EPOCHS = 12
LAMBDA = 1e-4
# One held-out text in four falls further below its language's median than the usual reach, which is one for all languages: texts with foreign passages do not widen it. The fewer held-out texts a language has, the less its median is worth: the allowance grows by SLACK over their number. A language without any is judged as one of the lowest median with one.
USUAL, REACH, SLACK = 0.75, 30.0, 20.0
# Trigrams of a text whose chance spread equals the spread between long texts.
SHORT = 100.0
# Language families by ISO 639 code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "be"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu", "ne"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def _folding() -> np.ndarray:
    fold = np.full(256, 0x20, np.uint8)
    fold[0x80:] = np.arange(0x80, 0x100)
    for c in range(ord("a"), ord("z") + 1):
        fold[c] = fold[c - 32] = c
    return fold


_FOLD = _folding()


def features(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(documents, 2**bits) counts of hashed trigrams; a text is taken as if between spaces."""
    n = len(offsets) - 1
    b = _FOLD[raw]
    latin = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)) + 1
    b[latin] += 0x20
    padded = np.full(len(b) + n, 0x20, np.uint32)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    padded[np.arange(len(b)) + doc] = b
    owner = np.repeat(np.arange(n), np.diff(offsets) + 1)
    before, two = np.full(len(padded), 0x20, np.uint32), np.full(len(padded), 0x20, np.uint32)
    before[1:], two[2:] = padded[:-1], padded[:-2]
    first = offsets[:-1] + np.arange(n)
    before[first] = 0x20
    two[first] = two[np.minimum(first + 1, len(two) - 1)] = 0x20
    code = (two << np.uint32(16)) | (before << np.uint32(8)) | padded
    keep = (before != 0x20) | (padded != 0x20)
    slot = (code * np.uint32(2654435761)) >> np.uint32(32 - bits)
    return np.bincount((owner * (1 << bits) + slot)[keep], minlength=n << bits).reshape(n, -1)


def _few(texts: pa.Array):
    """Texts as N._slices gives them, at most ROWS at a time."""
    for a, b, raw, offsets in N._slices(texts):
        for c in range(0, b - a, ROWS):
            own = offsets[c : c + ROWS + 1]
            yield a + c, min(b, a + c + ROWS), raw[own[0] : own[-1]], own - own[0]


def _unit(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts, dtype=np.float32)
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
    return x


def _svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear SVM; each class weighs the same."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y)
    w, mean, step = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    order = np.random.default_rng(11)
    for epoch in range(EPOCHS):
        for batch in np.array_split(order.permutation(len(y)), max(1, len(y) // 16)):
            step += 1
            rate = 1.0 / (LAMBDA * (step + 1000))
            out = y[batch] * (x[batch] @ w) < 1
            w *= 1 - rate * LAMBDA
            w += rate * ((y[batch] * weight[batch])[out] @ x[batch][out]) / len(batch)
            w *= min(1.0, 1.0 / np.sqrt(LAMBDA) / max(np.sqrt(w @ w), 1e-12))
        if epoch >= EPOCHS // 2:
            mean += w
    return mean / (EPOCHS - EPOCHS // 2)


def _families(langs) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for lang in sorted(langs):
        out.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    return out


def _pairs(langs) -> list[tuple[str, str]]:
    """Each two languages of a family."""
    return [(a, b) for own in _families(langs).values() for i, a in enumerate(own) for b in own[i + 1 :]]


class Model:
    """Families, their trigram log-probabilities, and the pairwise machines of each family's languages."""

    def __init__(self, counts: np.ndarray, langs: list[str], bits: int = BITS):
        at, x = np.array(langs), _unit(counts)
        self._set({lang: counts[at == lang].sum(axis=0, dtype=np.float64) for lang in set(langs)}, bits)
        for a, b in _pairs(set(langs)):
            of = (at == a) | (at == b)
            self.machines[a, b] = _svm(x[of], np.where(at[of] == a, 1.0, -1.0))

    @classmethod
    def of(cls, sums: dict[str, np.ndarray], machines: dict[tuple[str, str], np.ndarray], bits: int = BITS) -> Model:
        """The model of trigram counts a language and of machines made elsewhere."""
        model = cls.__new__(cls)
        model._set(sums, bits)
        model.machines = machines
        return model

    def _set(self, sums: dict[str, np.ndarray], bits: int) -> None:
        self.bits, self.families = bits, _families(sums)
        log, self.machines, self.trigrams = [], {}, {}
        for own in self.families.values():
            shares = [sums[lang] / max(sums[lang].sum(), 1) for lang in own]
            smooth = lambda share: np.log(share * 0.999 + 0.001 / (1 << bits))
            log.append(smooth(sum(shares) / len(own)))
            self.trigrams |= {lang: smooth(share) for lang, share in zip(own, shares, strict=True)}
        self.log = np.array(log)

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        total = np.maximum(counts.sum(axis=1), 1)
        scores = (counts @ self.log.T) * np.minimum(1.0, WEIGHT / total)[:, None]
        post = np.exp(scores - scores.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        names, pick = list(self.families), post.argmax(axis=1)
        x = _unit(counts)
        langs, score = [""] * len(counts), np.zeros(len(counts))
        for f, family in enumerate(names):
            rows = np.flatnonzero(pick == f)
            own = self.families[family]
            wins, sure = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for i, a in enumerate(own):
                for j in range(i + 1, len(own)):
                    w = self.machines[a, own[j]]
                    p = 1 / (1 + np.exp(-np.clip(2 * (x[rows] @ w[:-1] + w[-1]), -50, 50)))
                    wins[:, i] += p >= 0.5
                    wins[:, j] += p < 0.5
                    sure[:, i] += p
                    sure[:, j] += 1 - p
            best = (wins + sure / (len(own) + 1)).argmax(axis=1) if len(own) > 1 else np.zeros(len(rows), int)
            for r, b in zip(rows, best, strict=True):
                langs[r] = own[b]
            mean = sure[np.arange(len(rows)), best] / (len(own) - 1) if len(own) > 1 else 1.0
            score[rows] = post[rows, f] * mean
        return langs, np.clip(score, 0.0, 1.0)

    def likelihood(self, counts: np.ndarray, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-probability of a trigram under the language given, and the factor by which a short text strays further."""
        total = np.maximum(counts.sum(axis=1), 1)
        mean, at = np.zeros(len(counts)), np.array(langs)
        for lang in set(langs):
            mean[at == lang] = counts[at == lang] @ self.trigrams[lang]
        return mean / total, np.sqrt(1 + SHORT / total)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _labelled(docs: DataFrame, out: bool) -> DataFrame:
    """doc_id, text and lang of the labelled rows with letters that are held out or not."""
    part = held_out(F.col("doc_id"))
    return docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & (part if out else ~part) & F.col("text").rlike(r"\p{L}"))


def _packed(batches):
    """(text, ..) to (f, ..), f the packed feature row."""
    for batch in batches:
        for a, b, raw, offsets in _few(batch.column(0)):
            rows = features(raw, offsets).astype(np.uint32)
            yield pa.record_batch([pa.array([zlib.compress(r.tobytes(), 1) for r in rows], pa.binary()), *[c.slice(a, b - a) for c in batch.columns[1:]]], names=["f", *batch.schema.names[1:]])


def _unpacked(rows: pa.ChunkedArray) -> np.ndarray:
    counts = np.empty((len(rows), 1 << BITS), np.float32)
    for i, r in enumerate(rows):
        counts[i] = np.frombuffer(zlib.decompress(r.as_buffer()), np.uint32)
    return counts


def _drawn() -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)


def _counted(batches):
    """(text, lang) to a task's (lang, n, sums), the packed trigram counts of its texts."""
    n: dict[str, int] = {}
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for a, b, raw, offsets in _few(batch.column(0)):
            langs = batch.column(1).slice(a, b - a).to_pylist()
            counts, at = features(raw, offsets), np.array(langs)
            for lang in set(langs):
                n[lang] = n.get(lang, 0) + int((at == lang).sum())
                sums[lang] = sums.get(lang, 0) + counts[at == lang].sum(axis=0)
    yield pa.record_batch([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([zlib.compress(sums[x].tobytes(), 1) for x in n], pa.binary())], names=["lang", "n", "sums"])


def _added(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x.as_buffer()), np.int64) for x in rows["sums"])
    return pa.table([rows["lang"].slice(0, 1), pa.array([sum(rows["n"].to_pylist())], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["lang", "n", "sums"])


def _mean(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), float) for x in rows["w"]) / sum(rows["n"].to_pylist())
    return pa.table([rows["pair"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["pair", "w"])


def learn(docs: DataFrame) -> Model | None:
    """A model of all labelled rows that are not held out; None if there are none."""
    usable = _labelled(docs, False)
    found = usable.select("text", "lang").mapInArrow(_counted, "lang string, n long, sums binary").groupBy("lang").applyInArrow(_added, "lang string, n long, sums binary").collect()
    if not found:
        return None
    n, pairs = {r.lang: r.n for r in found}, _pairs([r.lang for r in found])
    sums = {r.lang: np.frombuffer(r.sums, np.int64).astype(float) for r in found}
    if not pairs:
        return Model.of(sums, {})
    dealt = []
    for k, two in enumerate(pairs):
        parts = -(-max(n[x] for x in two) // PER_LANG)
        dealt += [(lang, k, lang == two[0], parts, min(parts, max(1, n[lang] // LEAST))) for lang in two]
    ways = docs.sparkSession.createDataFrame(dealt, "lang string, pair int, first boolean, parts int, own int")
    rows = usable.withColumn("u", _drawn()).select("text", "lang", "u").mapInArrow(_packed, "f binary, lang string, u double").join(F.broadcast(ways), "lang")
    heap = F.pmod(F.xxhash64("u", "f"), F.col("own")).cast("int")
    rows = rows.withColumn("part", F.explode(F.sequence(heap, F.col("parts") - 1, F.col("own")))).select("f", "u", "first", "pair", "part", F.floor(F.col("part") / PARTS).alias("group"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending"), ("first", "descending"), ("u", "ascending"), ("f", "ascending")])
        part, w, made = group["part"].to_numpy(), 0.0, 0
        for k in np.unique(part):
            a, b = np.searchsorted(part, [k, k + 1])
            y = np.where(group["first"].slice(a, b - a).to_numpy(), 1.0, -1.0)
            w, made = w + _svm(_unit(_unpacked(group["f"].slice(a, b - a))), y), made + 1
        return pa.table([group["pair"].slice(0, 1), pa.array([made], pa.int64()), pa.array([w.tobytes()], pa.binary())], ["pair", "n", "w"])

    machines = rows.groupBy("pair", "group").applyInArrow(run, "pair int, n long, w binary").groupBy("pair").applyInArrow(_mean, "pair int, w binary").collect()
    return Model.of(sums, {pairs[r.pair]: np.frombuffer(r.w, float) for r in machines})


def train(docs: DataFrame, per_lang: int = PER_LANG, sample: int = SAMPLE) -> Model | None:
    """A quick model of a bounded sample of the labelled rows that are not held out; None if there are none."""
    usable = _labelled(docs, False)
    counted = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counted:
        return None
    most = max(1, min(per_lang, sample // len(counted)))
    shares = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 1.3 * most / r.n + 10 / r.n)) for r in counted], "lang string, share double")
    few = usable.withColumn("u", _drawn()).join(F.broadcast(shares), "lang").filter("u < share").select("text", "lang", "u")
    rows = few.mapInArrow(_packed, "f binary, lang string, u double").toArrow().sort_by([("lang", "ascending"), ("u", "ascending"), ("f", "ascending")])
    langs = rows["lang"].to_pylist()
    at, n = [], {}
    for i, lang in enumerate(langs):
        n[lang] = n.get(lang, 0) + 1
        if n[lang] <= most:
            at.append(i)
    return Model(_unpacked(rows["f"].take(pa.array(at))), [langs[i] for i in at])


def calibrate(docs: DataFrame, model: Model | None) -> dict[str, tuple[float, float]]:
    """Per language the median of the likelihood, and how far below it a long text may fall, over all held-out rows told as labelled.

    Likelihoods are taken in steps of 1e-4, so that quantiles are those of a bounded number of values and their counts.
    """
    if model is None:
        return {}
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for a, b, raw, offsets in _few(batch.column(0)):
                counts = features(raw, offsets)
                langs, _ = sent.value.predict(counts)
                mean, wide = sent.value.likelihood(counts, langs)
                told = pa.array([x == y for x, y in zip(langs, batch.column(1).slice(a, b - a).to_pylist(), strict=True)], pa.bool_())
                yield pa.record_batch([pa.array(langs, pa.string()), pa.array(mean), pa.array(wide), told], names=["lang", "mean", "wide", "told"])

    told = materialise(_labelled(docs, True).select("text", "lang").mapInArrow(run, "lang string, mean double, wide double, told boolean").filter("told").drop("told"), "told")
    step = lambda x: F.round(x, 4).alias("x")
    middles = told.groupBy("lang", step(F.col("mean"))).agg(F.count("*").alias("n")).groupBy("lang").agg(F.percentile("x", 0.5, F.col("n")).alias("centre"), F.sum("n").alias("n")).collect()
    if not middles:
        return {}
    centres, n = {r.lang: r.centre for r in middles}, {r.lang: r.n for r in middles}
    near = docs.sparkSession.createDataFrame(list(centres.items()), "lang string, centre double")
    fallen = told.join(F.broadcast(near), "lang").groupBy(step((F.col("centre") - F.col("mean")) / F.col("wide"))).agg(F.count("*").alias("n"))
    reach = fallen.agg(F.percentile("x", USUAL, F.col("n")).alias("reach")).first()["reach"]
    rest = min(centres.values())
    return {lang: (centres.get(lang, rest), REACH * reach + SLACK / max(n.get(lang, 0), 1)) for own in model.families.values() for lang in own}


def identify(docs: DataFrame, model: Model | None, usual: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """docs with lang_pred and score, and foreign if what calibrate() found is given."""
    added = ["lang_pred", "score"] + ["foreign"] * (usual is not None)
    hidden, back = shielded(docs)
    back = [x for c, x in zip(docs.columns, back, strict=True) if c not in added]
    given, text = docs.toDF(*hidden), F.col(hidden[docs.columns.index("text")])
    if model is None:
        return given.select(*back, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), *[F.lit(False).alias(c) for c in added[2:]])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {"lang_pred": T.StringType(), "score": T.DoubleType(), "foreign": T.BooleanType()}
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in given.schema] + [T.StructField(c, kinds[c]) for c in added])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 2)
            lettered = batch.column(batch.num_columns - 1).to_pylist()
            langs, scores, strange = [], [], []
            for a, b, raw, offsets in _few(texts):
                counts = features(raw, offsets)
                found, score = sent.value.predict(counts)
                if usual is not None:
                    mean, wide = sent.value.likelihood(counts, found)
                    floor = [usual[x][0] - usual[x][1] * w if x in usual else -np.inf for x, w in zip(found, wide, strict=True)]
                    strange += [lettered[a + i] and bool(mean[i] < floor[i]) for i in range(b - a)]
                for i in range(b - a):
                    langs.append(found[i] if lettered[a + i] else "und")
                    scores.append(float(score[i]) if lettered[a + i] else 0.0)
            yield pa.record_batch([*batch.columns[:-2], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *[pa.array(strange, pa.bool_()) for _ in added[2:]]], names=schema.names)

    told = given.select("*", text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter")).mapInArrow(run, schema)
    return told.select(*back, *added)


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
