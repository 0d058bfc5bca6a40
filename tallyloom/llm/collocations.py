"""Phrases whose words stand together more often than apart.

Texts are cut into pieces, and identical pieces of a language become one row with a
multiplicity. Tasks turn pieces into weighted n-grams, summed per task; the sums are dealt
to hash buckets in compressed blocks, and duckdb counts each bucket out of core. Words and
pairs come first; a longer phrase is counted only if all its pairs are frequent. What a phrase's score needs
of its parts is asked for by shuffled requests that meet the parts' counts by a join.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, discard, materialise, mix64

#: Bytes of pieces that a task turns into n-grams at once, and words of them that one step sorts.
CHUNK_BYTES, STEP_WORDS = 6 << 20, 1 << 19
#: Frequent pairs of words up to which longer phrases are sought among them alone, and bits of the filter for each.
FILTER_PAIRS, FILTER_BITS = 8_000_000, 16
#: Bytes of text for each hash bucket while there are at most MOST_BUCKETS, and the most of them; memory that duckdb may use before it spills.
BUCKET_BYTES, MOST_BUCKETS, LARGEST_BUCKET, COUNT_MEMORY = 4 << 20, 4096, 256 << 20, "256MB"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pieces(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """Rows lang (url-encoded: it then holds no tab or newline), piece, m: the distinct pieces of a language, words set apart by one space, and how often each occurs."""
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    cut = docs.select(F.url_encode(F.coalesce(F.col(lang_col), F.lit("und"))).alias("lang"), F.explode(F.split(lower, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    even = cut.select("lang", F.trim(F.regexp_replace("piece", r"[ \t]+", " ")).alias("piece")).where("piece <> ''")
    return even.groupBy("lang", "piece").agg(F.count("*").alias("m"))


def ranked(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct strings in order of their bytes, their hashes, and the place of each row's string among them."""
    coded = column.cast(pa.large_binary()).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), dtype=np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    names = coded.dictionary.take(order)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names.to_pylist()), dtype=np.uint64, count=len(names))
    return names, hashes, place[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, dtype=np.int64)


def follow(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of what stands before their last word, and that word's."""
    return mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + words)


def grams(langs: pa.Array, texts: pa.Array, weights: np.ndarray, first: int, longest: int, pairs: np.ndarray | None = None):
    """The distinct n-grams of ``first`` to ``longest`` words of the pieces, in order of their bytes: (keys, hashes, f), f the sum of their pieces' weights.

    A key is language, tab, words set apart by a space, and a newline; neither tab nor
    newline stands in a word. With ``first`` 1, a key without words counts all words of
    a language. ``pairs``, bits by hash, knows all frequent pairs of words: longer n-grams
    that hold a pair it does not know are passed over, since they are no more frequent.
    """
    split = pc.split_pattern(texts.cast(pa.large_string()), " ")
    size = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    words, word_hash, named = ranked(split.flatten())
    spoken, lang_hash, lang = ranked(langs)
    lang = np.repeat(lang, size)
    end, weight = np.repeat(np.cumsum(size), size), np.repeat(weights, size)

    def keys(of, *parts):
        heads = pc.binary_join_element_wise(spoken.take(pa.array(of)), parts[0] if parts else pa.scalar(b"", pa.large_binary()), pa.scalar(b"\t", pa.large_binary()))
        return pc.binary_join_element_wise(heads, *parts[1:], pa.scalar(b" ", pa.large_binary())) if parts[1:] else heads

    def closed(column):
        return pc.binary_join_element_wise(column, pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary()))

    if first == 1:
        total = np.bincount(lang, weights=weight, minlength=len(spoken))
        yield closed(keys(np.arange(len(total)))), lang_hash, np.rint(total).astype(np.int64)
    known = None
    if pairs is not None and len(named):
        one = follow(lang_hash[lang], word_hash[named])
        two = follow(one[:-1], word_hash[named[1:]]) & np.uint64(8 * len(pairs) - 1)
        known = np.append((pairs[(two >> np.uint64(3)).astype(np.int64)] >> (two & np.uint64(7)).astype(np.uint8)) & 1, 0).astype(bool)
    for a in range(0, len(named), STEP_WORDS):
        at = np.arange(a, min(a + STEP_WORDS, len(named)))
        if known is not None:
            at = at[known[at]]
        at = at[at + first <= end[at]]
        before, hashes = lang[at], lang_hash
        for n in range(1, longest + 1):
            inside = at + n <= end[at]
            if known is not None and n >= 3:
                inside[inside] = known[at[inside] + n - 2]
            at, before = at[inside], before[inside]
            coded, start, again = np.unique(before * len(words) + named[at + n - 1], return_index=True, return_inverse=True)
            hashes = follow(hashes[coded // max(len(words), 1)], word_hash[coded % max(len(words), 1)])
            before, places = again, at[start]
            if n >= first:
                phrase = closed(keys(lang[places], *(words.take(pa.array(named[places + j])) for j in range(n))))
                yield phrase, hashes, np.rint(np.bincount(before, weights=weight[at], minlength=len(start))).astype(np.int64)


def packed(keys: pa.Array, hashes: np.ndarray, f: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows bucket, n, size, keys, f: the n-grams of each bucket as one compressed block, neighbours in order of their bytes."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    keys, f, bucket = keys.take(pa.array(order)), f[order], bucket[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, dtype=np.int64)
    place = np.frombuffer(keys.buffers()[1], dtype=np.int64, count=len(keys) + 1 + keys.offset)[keys.offset:] if len(keys) else np.zeros(1, dtype=np.int64)
    data = memoryview(keys.buffers()[2]) if len(keys) and keys.buffers()[2] else memoryview(b"")
    rows = {"bucket": [], "n": [], "size": [], "keys": [], "f": []}
    for p, q in zip(cut, cut[1:]):
        block = data[place[p] : place[q]]
        for name, x in zip(rows, (int(bucket[p]), int(q - p), len(block), pa.compress(block, "zstd", asbytes=True), pa.compress(f[p:q].tobytes(), "zstd", asbytes=True))):
            rows[name].append(x)
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], list(rows))


def unpacked(n: int, size: int, keys: bytes, f: bytes) -> pa.RecordBatch:
    block = pa.decompress(keys, size, "zstd", asbytes=True)
    ends = np.flatnonzero(np.frombuffer(block, dtype=np.uint8) == 10) + 1
    places = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64).tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.Array.from_buffers(pa.large_string(), n, [None, places, pa.py_buffer(block)]), pa.Array.from_buffers(pa.int64(), n, [None, pa.py_buffer(pa.decompress(f, 8 * n, "zstd", asbytes=True))])], ["key", "f"])


def counted(cut: DataFrame, buckets: int, first: int, longest: int, least: int, pairs: np.ndarray | None) -> DataFrame:
    """Rows lang, words, phrase, f of the phrases of ``first`` to ``longest`` words in the pieces ``cut`` with f >= ``least``."""
    shared = cut.sparkSession.sparkContext.broadcast(pairs)

    def spread(batches):
        held, size = [], 0
        for part in blocks(batches, 1, CHUNK_BYTES):
            held.append(part)
            size += part.column(1).nbytes
            if size >= CHUNK_BYTES:
                yield from joined(held)
                held, size = [], 0
        if held:
            yield from joined(held)

    def joined(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        langs, texts, m = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns)
        for found in grams(langs, texts, m.to_numpy(), first, longest, shared.value):
            yield packed(*found, buckets)

    def count(batches):
        import duckdb

        kinds = pa.schema([("key", pa.large_string()), ("f", pa.int64())])
        met = (unpacked(*(batch.column(c)[i].as_py() for c in ("n", "size", "keys", "f"))) for batch in batches for i in range(batch.num_rows))
        # the folder is the task's own spill space, gone when the bucket is counted
        with tempfile.TemporaryDirectory(prefix="phrases-") as spill, duckdb.connect(config={"threads": 1, "memory_limit": COUNT_MEMORY, "temp_directory": spill, "preserve_insertion_order": False}) as db:
            db.register("met", pa.RecordBatchReader.from_batches(kinds, met))
            found = db.sql(f"SELECT key, CAST(sum(f) AS BIGINT) AS f FROM met GROUP BY key HAVING sum(f) >= {int(least)}")
            yield from found.to_arrow_reader(1 << 16)

    dealt = cut.mapInArrow(spread, "bucket int, n int, size long, keys binary, f binary").repartition(buckets, "bucket")
    rows = dealt.mapInArrow(count, "key string, f long").withColumn("key", F.expr("substr(key, 1, length(key) - 1)"))
    lang = F.url_decode(F.substring_index("key", "\t", 1))
    phrase = F.substr("key", F.locate("\t", "key") + 1)
    return rows.select(lang.alias("lang"), F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " "))).alias("words"), phrase.alias("phrase"), "f")


def pair_filter(counts: DataFrame) -> np.ndarray | None:
    """Bits that know the hash of every counted pair; None beyond FILTER_PAIRS (16 MB of bits, 64 MB of hashes on the driver): then every longer phrase is counted."""
    pairs = counts.where("words = 2").select(F.url_encode("lang").alias("lang"), "phrase")
    n = pairs.count()
    if n > FILTER_PAIRS:
        return None

    def hashed(batches):
        for batch in batches:
            split = pc.split_pattern(batch.column(1).cast(pa.large_string()), " ")
            _, words, place = ranked(split.flatten())
            _, langs, lang = ranked(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(follow(follow(langs[lang], words[place[0::2]]), words[place[1::2]]).astype(np.int64))], ["h"])

    size = 64
    while size < n * FILTER_BITS:
        size *= 2
    at = pairs.mapInArrow(hashed, "h long").toArrow().column(0).to_numpy().astype(np.uint64) & np.uint64(size - 1)
    bits = np.zeros(size, dtype=bool)
    bits[at.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def phrase_counts(docs: DataFrame, lang_col: str, text_col: str, longest: int, least: int) -> DataFrame:
    """Rows lang, words, phrase, f of all phrases of 1 to ``longest`` words with f >= ``least``; words = 0 counts a language's words.

    Words and pairs are counted first; longer phrases then only where each of their pairs
    is frequent.
    """
    bytes_ = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    each = max(BUCKET_BYTES, min(LARGEST_BUCKET, bytes_ // MOST_BUCKETS))
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), bytes_ // each + 1)
    cut = materialise(pieces(docs, lang_col, text_col), "pieces")
    short = materialise(counted(cut, buckets, 1, min(longest, 2), least, None), "words-and-pairs")
    if longest < 3:
        return short
    out = materialise(short.unionByName(counted(cut, buckets, 3, longest, least, pair_filter(short))), "phrases")
    discard(cut, short)
    return out


def collocations(
    df: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 4, least: int = 30, absorbed: int = 80, top: int = 2000,
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``longest`` words that occurs ``least`` times or more is scored at
    its worst cut: floor(2000000 * a / (l + r)), l and r the counts of the two parts, the
    earliest cut among equals. Phrases inside a longer one that has ``absorbed`` per cent
    of their occurrences or more are left out. Null text is empty; a null language is
    ``und``; repeated rows count each; ties rank by count, then by the phrase's bytes; an
    empty table gives no rows; further columns are ignored. Every count is exact: of a
    candidate's parts none is rarer than ``least``, so rarer phrases need not be kept.
    """
    counts = phrase_counts(df, lang_col, text_col, longest, least)
    candidates = counts.where("words >= 2").select("lang", "words", "phrase", F.col("f").alias("a"))
    wide = lambda x: F.col(x).cast("decimal(20,0)")
    parts = F.split("phrase", " ")
    sides = F.flatten(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit("l").alias("side"), F.concat_ws(" ", F.slice(parts, 1, k)).alias("part")),
        F.struct(k.alias("k"), F.lit("r").alias("side"), F.concat_ws(" ", F.slice(parts, k + 1, F.col("words") - k)).alias("part")))))
    asked = candidates.select("lang", "phrase", "a", F.inline(sides))
    known = counts.where(F.col("words").between(1, longest - 1)).select("lang", F.col("phrase").alias("part"), "f")
    cuts = [k for k in range(1, longest)]
    told = asked.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a").agg(
        *(F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}") for k in cuts for side in "lr"))
    for k in cuts:
        told = told.withColumn(f"s{k}", F.expr(f"(cast(a as decimal(20,0)) * 2000000) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))"))
    worst = F.array_min(F.filter(F.array(*(F.struct(F.col(f"s{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in cuts)), lambda x: x["score"].isNotNull()))
    scored = told.select("lang", "phrase", "a", worst.alias("worst")).select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score")
    if longest > 2:
        inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(
            F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.concat_ws(" ", F.slice(parts, i, k)))))
        around = candidates.where("words >= 3").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("f")).groupBy("lang", "phrase").agg(F.max("f").alias("around"))
        scored = scored.join(around, ["lang", "phrase"], "left").where(
            F.col("around").isNull() | (wide("around") * 100 < wide("a") * absorbed)).drop("around")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    spoken = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(spoken, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_split_to_array(trim(piece, ' ' || chr(9)), '[\x20\x09]+') AS ws FROM p WHERE trim(piece, ' ' || chr(9)) <> ''
), d AS (
  SELECT lang, ws, count(*) AS m FROM w GROUP BY lang, ws
), o AS (
  SELECT lang, ws, m, unnest(range(1, len(ws) + 1)) AS i FROM d
), g AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, CAST(sum(m) AS BIGINT) AS f
  FROM o, range(1, 5) AS t(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL
), t AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k AS words, phrase, string_split(phrase, ' ') AS ws, f AS a FROM g WHERE k >= 2 AND f >= 30
), x AS (
  SELECT c.lang, c.phrase, c.a, cut, g1.f AS l, g2.f AS r, CAST((2000000::HUGEINT * c.a) // (g1.f::HUGEINT + g2.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, words)) AS cut FROM c) AS c
  JOIN g AS g1 ON g1.lang = c.lang AND g1.phrase = array_to_string(c.ws[1 : cut], ' ')
  JOIN g AS g2 ON g2.lang = c.lang AND g2.phrase = array_to_string(c.ws[cut + 1 : words], ' ')
), s AS (
  SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), u AS (
  SELECT lang, array_to_string(ws[i : i + k - 1], ' ') AS phrase, max(a) AS f
  FROM (SELECT *, unnest(range(1, words)) AS i FROM c WHERE words >= 3), range(2, 4) AS t(k) WHERE k < words AND i + k - 1 <= words GROUP BY ALL
), v AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, encode(s.phrase)) AS rank
  FROM s LEFT JOIN u ON u.lang = s.lang AND u.phrase = s.phrase
  WHERE u.f IS NULL OR 100::HUGEINT * u.f < 80::HUGEINT * s.a
)
SELECT v.lang, v.rank, v.phrase, v.a, v.l, v.r, t.n, v.score FROM v JOIN t ON t.lang = v.lang WHERE v.rank <= 2000
"""
