"""Language identification with interpolated Kneser-Ney character models.

Character n-grams of the training rows are counted over whole texts. Discounts,
continuation counts, back-off weights and probabilities of every language come from
Spark aggregates and joins over all of them: nothing is cut off by count. The model
is kept as written tables and scored from sorted arrays of 64-bit n-gram hashes,
searched by bisection. A text gets the language of the lowest cross-entropy per
symbol; a language rejects what is stranger than all but a small share of texts of
its own that it did not learn from.

A model grows with its corpus, so arrays are made in blocks of a bounded size, by
groups of languages and by the symbol before the one that is predicted: all that a
place in a word needs is in one block, and the parts of a text's log probability add
up. A model of one block is scored in one narrow pass; of more, in one pass a block,
whose few numbers a text are shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactum.llm.common import Workspace, checked_broadcast, in_small_batches

ORDER = 4
#: Bytes of one block of arrays, and the languages that share one.
BLOCK_BYTES = 64 << 20
BLOCK_LANGS = 8
#: How often the number of blocks may grow until all are small enough; one symbol's share is not divided.
TRIALS = 4
#: One text in so many sets the limits and the sharpness and does not teach; languages
#: of fewer rows teach with all of them and take the widest limit of the others.
CALIBRATION_FOLDS = 10
CALIBRATION_LEAST = 500
#: Share of a language's own texts that its limit lets pass.
ACCEPTED = 0.999
#: What may spread differences of nats per symbol over the scores: the likeliest on the calibration rows is taken.
SHARPNESS = (1.0, 2.0, 5.0, 10.0, 20.0, 40.0, 80.0)
#: Words whose scores a Python worker keeps; the store is emptied when full.
CACHE_WORDS = 400_000

LETTERS = re.compile(r"[^\W\d_]+")
START, END = "\x02", "\x03"


def grams_of(word: str, order: int = ORDER):
    """For each symbol after the start mark the gram that ends there, as long as the order allows."""
    s = START + word + END
    for i in range(1, len(s)):
        yield s[max(0, i - order + 1) : i + 1]


def count_grams(rows: DataFrame, text: str, lang: str, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all rows; partitions sum up before anything is shuffled."""
    cur = rows.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def batch_of(words: dict[str, Counter]):
        langs, grams, counts = [], [], []
        for who, seen in words.items():
            total: dict[str, int] = defaultdict(int)
            for w, n in seen.items():
                for g in grams_of(w, order):
                    total[g] += n
            langs += [who] * len(total)
            grams += total.keys()
            counts += total.values()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    def run(batches):
        words: dict[str, Counter] = defaultdict(Counter)
        for b in in_small_batches(batches, 500):
            for who, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words[who].update(LETTERS.findall(t.as_py().lower()))
            if sum(map(len, words.values())) > 250_000:
                yield batch_of(words)
                words.clear()
        if words:
            yield batch_of(words)

    return cur.mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


_M = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """h[n][i]: the hash of the n codes that end at i (nonsense for i < n - 1)."""
    out = [np.zeros(len(codes), np.uint64)]
    for n in range(1, order + 1):
        h = np.full(len(codes), n, np.uint64)
        for back in range(n - 1, -1, -1):
            c = np.zeros(len(codes), np.uint64)
            c[back:] = codes[: len(codes) - back] if back else codes
            h = _mixed(h * _M + c)
        out.append(h)
    return out


def _hash_one(grams: list[str]) -> np.ndarray:
    """Hashes of grams that all have the same length."""
    n = len(grams[0])
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(-1, n)
    h = np.full(len(grams), n, np.uint64)
    for i in range(n):
        h = _mixed(h * _M + codes[:, i])
    return h


def _part_of(codes: np.ndarray, parts: int) -> np.ndarray:
    """The block of symbols that a code point belongs to."""
    return _mixed(codes.astype(np.uint64) * _M) % np.uint64(parts)


def _hashed(rows: DataFrame, parts: int) -> DataFrame:
    """(lang, n, part, h, suffix, context, v) of rows (lang, kind, g, v).

    The part is that of the symbol before the last of a gram (kind g), of the last
    of a context (kind c); -1, of all parts, for single symbols.
    """

    def run(batches):
        for b in in_small_batches(batches, 50_000):
            kinds, grams = np.array(b.column(1).to_pylist()), b.column(2).to_pylist()
            lengths = np.fromiter(map(len, grams), np.int64, len(grams))
            h, suffix, context = (np.zeros(len(grams), np.uint64) for _ in range(3))
            part = np.full(len(grams), -1, np.int64)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                some = [grams[i] for i in at]
                h[at] = _hash_one(some)
                if n > 1:
                    suffix[at], context[at] = _hash_one([g[1:] for g in some]), _hash_one([g[:-1] for g in some])
                back = np.where(kinds[at] == "c", 1, 2)
                told = back <= n
                part[at[told]] = _part_of(np.array([ord(g[-k]) for g, k, t in zip(some, back, told, strict=True) if t], np.uint64), parts)
            arrays = [b.column(0), b.column(1), pa.array(lengths.astype(np.int32)), pa.array(part.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (h, suffix, context)), b.column(3)]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "kind", "n", "part", "h", "suffix", "context", "v"])

    return rows.mapInArrow(run, "lang string, kind string, n int, part int, h bigint, suffix bigint, context bigint, v double")


def kneser_ney(counts: DataFrame, space: Workspace, order: int = ORDER) -> tuple[DataFrame, dict[str, float]]:
    """Rows (lang, kind, g, v): log probabilities of grams (g), log back-off weights of contexts (c);
    and for each language the log probability of a symbol that it never saw.

    ``counts`` is a written table (lang, gram, n). Below the highest order a gram counts
    the different symbols before it, except after the start mark, where it has its own
    count. The discount of an order is n1 / (n1 + 2 n2), within 0.05 and 0.95. Beyond
    the lowest order all symbols of all languages and one more are equally likely.
    """
    level, levels = None, None
    for n in range(order, 0, -1):
        c = counts.where(F.length("gram") == n).select("lang", F.col("gram").alias("g"), F.col("n").alias("c"))
        if level is not None:
            longer = level.groupBy("lang", F.expr("substring(g, 2)").alias("g")).agg(F.count(F.lit(1)).alias("c"))
            c = longer.unionByName(c.where(F.col("g").startswith(START)))
        level = c
        some = level.select("lang", F.lit(n).alias("n"), F.expr(f"substring(g, 1, {n - 1})").alias("h"), "g", "c")
        levels = some if levels is None else levels.unionByName(some)
    levels = space.write(levels, "levels")
    floor = 1.0 / (levels.where("n = 1").select("g").distinct().count() + 1)
    ones = levels.groupBy("lang", "n").agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"))
    d = F.when(F.col("n1") > 0, F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))))).otherwise(0.5)
    heads = levels.groupBy("lang", "n", "h").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds")).join(ones.select("lang", "n", d.alias("d")), ["lang", "n"])
    heads = space.write(heads.select("lang", "n", "h", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("lam")), "heads")
    lowest = {r["lang"]: math.log(r["lam"] * floor) for r in heads.where("n = 1").select("lang", "lam").toLocalIterator()}
    out = heads.where("n > 1").select("lang", F.lit("c").alias("kind"), F.col("h").alias("g"), F.log("lam").alias("v"))
    below = None
    for n in range(1, order + 1):
        found = levels.where(F.col("n") == n).drop("n").join(heads.where(F.col("n") == n).drop("n"), ["lang", "h"])
        lower = F.lit(floor)
        if below is not None:
            found = found.withColumn("tail", F.expr("substring(g, 2)")).join(below.select("lang", F.col("g").alias("tail"), F.col("p").alias("lower")), ["lang", "tail"])
            lower = F.col("lower")
        below = space.write(found.select("lang", "g", ((F.col("c") - F.col("d")) / F.col("total") + F.col("lam") * lower).alias("p")), "probabilities")
        out = out.unionByName(below.select("lang", F.lit("g").alias("kind"), "g", F.log("p").alias("v")))
    return out, lowest


class Block:
    """Sorted hash arrays of grams and contexts of some languages and some symbols, a column per language."""

    def __init__(self, unknown: np.ndarray, order: int, part: int, parts: int):
        self.unknown, self.order, self.part, self.parts = unknown.astype(np.float32), order, part, parts
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = [self._table(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0), 0.0)]

    def _table(self, h: np.ndarray, lang: np.ndarray, v: np.ndarray, default) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes, sorted, and a row of values for each."""
        keys, at = np.unique(h, return_inverse=True)
        values = np.empty((len(keys), len(self.unknown)), np.float32)
        values[:] = default
        values[at, lang] = v
        return keys, values

    def fill(self, n: int, grams: tuple[np.ndarray, ...], contexts: tuple[np.ndarray, ...] | None) -> None:
        """Takes the grams of length ``n`` (h, suffix, context, lang, v) and the contexts before them (h, lang, v).

        A language without a gram gets what backing off gives it, so that one search serves all.
        """
        h, suffix, context, lang, v = grams
        if n == 1:
            self.grams.append(self._table(h, lang, v, self.unknown))
            return
        self.contexts.append(self._table(*contexts, 0.0))
        keys, first, at = np.unique(h, return_index=True, return_inverse=True)
        lower, weights = self.grams[n - 2], self.contexts[n - 1]
        values = lower[1][np.searchsorted(lower[0], suffix[first])] + weights[1][np.searchsorted(weights[0], context[first])]
        values[at, lang] = v
        self.grams.append((keys, values))

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = table[0]
        if not len(keys):
            return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return at, keys[at] == asked

    def score_words(self, words: list[str]) -> np.ndarray:
        """Summed log probabilities (words x languages) of the places that are this block's."""
        lengths = np.array([len(w) + 2 for w in words])
        codes = np.frombuffer("".join(START + w + END for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place = np.arange(len(codes)) - np.repeat(starts, lengths)
        h = _hashes(codes, self.order)
        total = np.zeros((len(codes), len(self.unknown)), np.float32)
        open_ = place > 0
        if self.parts > 1:
            open_[1:] &= _part_of(codes[:-1], self.parts) == self.part
        for n in range(self.order, 0, -1):
            asked = np.flatnonzero(open_ & (place >= n - 1))
            if not len(asked):
                continue
            at, hit = self._find(self.grams[n - 1], h[n][asked])
            total[asked[hit]] += self.grams[n - 1][1][at[hit]]
            open_[asked[hit]] = False
            missed = asked[~hit]
            if n > 1 and len(missed):
                at, hit = self._find(self.contexts[n - 1], h[n - 1][missed - 1])
                total[missed[hit]] += self.contexts[n - 1][1][at[hit]]
        total[open_] += self.unknown
        return np.add.reduceat(total, starts, axis=0)


class Model:
    """Where the hashed tables are written, and the few numbers that each language has."""

    def __init__(self, tables: DataFrame, unknown: dict[str, float], order: int = ORDER, parts: int = 1):
        self.tables, self.order, self.parts = tables, order, parts
        self.langs = sorted(unknown)
        self.unknown = np.array([unknown[x] for x in self.langs])
        self.limits = np.full(len(self.langs), np.inf)
        self.sharpness = 20.0
        self._held: tuple | None = None

    def places(self) -> list[tuple[int, int]]:
        """(first language, part of the symbols) of every block."""
        return [(k, p) for k in range(0, len(self.langs), BLOCK_LANGS) for p in range(self.parts)]

    def block(self, place: tuple[int, int]) -> Block:
        """Brings one block to the driver; the last one is kept."""
        if self._held and self._held[0] == place:
            return self._held[1]
        first, part = place
        langs = self.langs[first : first + BLOCK_LANGS]
        b = Block(self.unknown[first : first + BLOCK_LANGS], self.order, part, self.parts)
        number = F.create_map(*[x for k, who in enumerate(langs) for x in (F.lit(who), F.lit(k))])
        rows = self.tables.where(F.col("lang").isin(langs) & F.col("part").isin(-1, part)).select(number[F.col("lang")].alias("lang"), "kind", "n", "h", "suffix", "context", "v").toArrow()
        lang, n, v = (rows.column(c).to_numpy() for c in ("lang", "n", "v"))
        h, suffix, context = (rows.column(c).to_numpy().view(np.uint64) for c in ("h", "suffix", "context"))
        gram = rows.column("kind").to_numpy(zero_copy_only=False) == "g"
        for k in range(1, self.order + 1):
            g, c = np.flatnonzero(gram & (n == k)), np.flatnonzero(~gram & (n == k - 1))
            b.fill(k, (h[g], suffix[g], context[g], lang[g], v[g]), (h[c], lang[c], v[c]) if k > 1 else None)
        self._held = (place, b)
        return b

    def score_words(self, words: list[str]) -> np.ndarray:
        """Summed log probabilities (words x languages), from all blocks."""
        out = np.zeros((len(words), len(self.langs)))
        for first, part in self.places():
            out[:, first : first + BLOCK_LANGS] += self.block((first, part)).score_words(words)
        return out


class Scorer:
    """Scores texts with one block, with a store of word scores."""

    def __init__(self, block: Block):
        self.block = block
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(block.unknown)), np.float32)

    def sums(self, texts: list[str | None]) -> list[tuple[np.ndarray | None, int]]:
        """(log probability for each language, symbols); None without letters."""
        counted = [Counter(LETTERS.findall(t.lower())) if t else Counter() for t in texts]
        new = list({w for c in counted for w in c if w not in self.known})
        # Signs such as superscript digits are word characters, but no letters.
        numbers = {w for w in new if not w.isascii() and not any(map(str.isalpha, w))}
        if numbers:
            counted = [Counter({w: n for w, n in c.items() if w not in numbers}) for c in counted]
            new = [w for w in new if w not in numbers]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            self.scores = self.scores[:0]
            new = list({w for c in counted for w in c})
        parts = [self.scores]
        for i in range(0, len(new), 20_000):
            parts.append(self.block.score_words(new[i : i + 20_000]))
        for w in new:
            self.known[w] = len(self.known)
        self.scores = np.concatenate(parts)
        out = []
        for c in counted:
            if not c:
                out.append((None, 0))
                continue
            at = np.fromiter(map(self.known.__getitem__, c), np.int64, len(c))
            n = np.fromiter(c.values(), np.float64, len(c))
            symbols = int(sum(n * (np.fromiter(map(len, c), np.int64, len(c)) + 1)))
            out.append((n @ self.scores[at].astype(np.float64), symbols))
        return out


def _summed(rows: DataFrame, block: Block, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``rows``, whose last column is the text, with sums and symbols."""
    fields = [rows.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "sums_ array<double>", "symbols_ bigint"])
    shared = rows.sparkSession.sparkContext.broadcast(block)
    width = len(fields)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in in_small_batches(batches, 200):
            found = scorer.sums(b.column(width).to_pylist())
            arrays = [pa.array([None if s is None else s.tolist() for s, _ in found], pa.list_(pa.float64())), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *arrays], names=[*(f.name for f in fields), "sums_", "symbols_"])

    return rows.mapInArrow(run, schema)


def entropies(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all but the text) with entropies_: nats per symbol for each language, null without letters."""
    names = [c for c in (docs.columns if keep is None else keep) if c != text]
    places = model.places()
    if len(places) == 1:
        rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`"))
        out = _summed(rows, model.block(places[0]), names)
    else:
        # Texts are known by two hashes from here on: equal ones have equal sums.
        space = Workspace(docs.sparkSession, "entropies")
        hashes = [F.xxhash64(F.col(f"`{text}`")).alias("h1_"), F.xxhash64(F.lit(1), F.col(f"`{text}`")).alias("h2_")]
        parts = None
        for first, part in places:
            found = _summed(docs.select(*hashes, F.col(f"`{text}`")).where(F.col(f"`{text}`").isNotNull()), model.block((first, part)), ["h1_", "h2_"]).where("sums_ IS NOT NULL").dropDuplicates(["h1_", "h2_"])
            found = space.write(found.select("h1_", "h2_", F.lit(first).alias("first"), F.lit(part).alias("part"), "sums_", "symbols_"), "sums")
            parts = found if parts is None else parts.unionByName(found)
        groups = []
        for first in range(0, len(model.langs), BLOCK_LANGS):
            width = len(model.langs[first : first + BLOCK_LANGS])
            groups.append(f"aggregate(filter(all_, x -> x.first = {first}), array_repeat(0D, {width}), (a, x) -> zip_with(a, x.sums_, (p, q) -> p + q))")
        sums = parts.groupBy("h1_", "h2_").agg(F.array_sort(F.collect_list(F.struct("first", "part", "sums_"))).alias("all_"), F.first("symbols_").alias("symbols_"))
        sums = space.write(sums.select("h1_", "h2_", F.expr(f"concat({', '.join(groups)})").alias("sums_"), "symbols_"), "texts")
        out = docs.select(*[F.col(f"`{c}`") for c in names], *hashes).join(sums, ["h1_", "h2_"], "left").drop("h1_", "h2_")
    return out.select(*[F.col(f"`{c}`") for c in names], F.expr("transform(sums_, x -> -x / symbols_)").alias("entropies_"))


def train(rows: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, accepted: float = ACCEPTED, block_bytes: int = BLOCK_BYTES, folds: int = CALIBRATION_FOLDS, least: int = CALIBRATION_LEAST) -> Model | None:
    """A model of the rows whose language is not null; None if there is none.

    Counts cover all texts but those of one of ``folds`` folds, by a hash of the text,
    of languages of ``least`` rows or more; all of that fold set the limits and the
    sharpness. Languages of fewer rows, whatever the size of the others, are learned
    from all their rows and take the widest of the limits. Only one block of arrays at
    a time, and a few numbers a language, come to the driver.
    """
    spark = rows.sparkSession
    space = Workspace(spark, "language")
    known = rows.select(F.col(f"`{lang}`").cast("string").alias("lang_"), F.col(f"`{text}`").alias("text_")).where("lang_ IS NOT NULL AND text_ IS NOT NULL")
    many = space.write(known.groupBy("lang_").count().where(F.col("count") >= least).select(F.col("lang_").alias("many_")), "many")
    known = known.join(checked_broadcast(many), F.col("lang_") == F.col("many_"), "left")
    spared = F.col("many_").isNotNull() & (F.pmod(F.xxhash64("text_"), F.lit(folds)) == 0)
    counts = space.write(count_grams(known.where(~spared), "text_", "lang_", order), "grams")
    if counts.isEmpty():
        return None
    tables, unknown = kneser_ney(counts, space, order)
    model = Model(tables, unknown, order, 1)
    each = 8 + 4 * min(BLOCK_LANGS, len(model.langs))
    for trial in range(TRIALS):
        hashed = space.write(_hashed(tables, model.parts), "hashed")
        first = F.floor((F.array_position(F.lit(model.langs), F.col("lang")) - 1) / BLOCK_LANGS)
        sizes = hashed.where("part >= 0").groupBy(first.alias("first"), "part").agg(F.count_distinct("h").alias("n"))
        largest = (sizes.agg(F.max("n")).first()[0] or 0) * each
        if largest <= block_bytes or trial == TRIALS - 1:
            break
        space.drop(hashed)
        model.parts *= min(64, math.ceil(1.5 * largest / block_bytes))
    model.tables = hashed

    own = entropies(known.where(spared).select("lang_", "text_"), model, "text_", ["lang_"]).where("entropies_ IS NOT NULL")
    own = own.withColumn("at_", F.array_position(F.lit(model.langs), F.col("lang_")).cast("int")).where("at_ > 0").withColumn("own_", F.expr("element_at(entropies_, at_)"))
    likelihoods = [F.sum(F.expr(f"-ln(aggregate(entropies_, 0D, (a, x) -> a + exp({s}D * (own_ - x))))")).alias(f"s{i}") for i, s in enumerate(SHARPNESS)]
    found = own.groupBy("lang_").agg(F.percentile_approx("own_", accepted, 10_000).alias("limit"), *likelihoods).collect()
    if found:
        limits = {r["lang_"]: r["limit"] for r in found}
        model.limits = np.array([limits.get(x, max(limits.values())) for x in model.langs])
        model.sharpness = SHARPNESS[int(np.argmax([sum(r[f"s{i}"] for r in found) for i in range(len(SHARPNESS))]))]
    return model


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, reject: bool = False, detail: bool = False) -> DataFrame:
    """Columns ``keep`` (default: all but the text) with lang_pred, score and rejected.

    ``und`` is the language of a null or letterless text (score 0), of every text if
    there is no model, and of rejected texts if ``reject`` is set. Equal entropies
    give the language that comes first by name. With ``detail`` also the entropies.
    Texts are read whole. Columns of ``docs`` with the added names are replaced.
    """
    added = ["lang_pred", "score", "rejected"] + (["entropies"] if detail else [])
    names = [c for c in (docs.columns if keep is None else keep) if c not in added and c != text]
    ask = [F.col(f"`{c}`") for c in names]
    if model is None:
        out = docs.select(*ask).withColumns({"entropies_": F.lit(None).cast("array<double>"), "lang_": F.lit("und"), "limit_": F.lit(None).cast("double"), "least_": F.lit(None).cast("double")})
        sharpness = 1.0
    else:
        out = entropies(docs, model, text, names).withColumn("least_", F.array_min("entropies_"))
        at = F.array_position("entropies_", F.col("least_")).cast("int")
        out = out.withColumns({"lang_": F.get(F.lit(model.langs), at - 1), "limit_": F.get(F.lit([float(x) for x in model.limits]), at - 1)})
        sharpness = model.sharpness
    strange = F.coalesce(F.col("least_") > F.col("limit_"), F.lit(False))
    name = F.coalesce(F.when(strange, F.lit("und")).otherwise(F.col("lang_")) if reject else F.col("lang_"), F.lit("und"))
    score = F.coalesce(1.0 / F.expr(f"aggregate(entropies_, 0D, (a, x) -> a + exp({sharpness}D * (least_ - x)))"), F.lit(0.0))
    more = [F.col("entropies_").alias("entropies")] if detail else []
    return out.select(*ask, name.alias("lang_pred"), score.alias("score"), strange.alias("rejected"), *more)


def fold(key: Column, n: int) -> Column:
    """The remainder of the CRC-32 of a key as text; null keys count as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))
