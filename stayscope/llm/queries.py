"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stayscope.llm import (
    archive, bpe, decontaminate, language, mixing, mixture, neighbours, quality, repeats, resample, secrets, simhash, variants,
)
from stayscope.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str) -> Callable[[Query], Query]:
    def keep(make: Query) -> Query:
        QUERIES[name] = make
        return make

    return keep


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents"), words=3, distance=2)


@query("op5_benchmark_decontamination")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.size("_hits").cast("long").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"),
        (F.size("_hits") > 0).alias("contaminated"),
    )


WORDS_SQL = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLES["op5_benchmark_decontamination"] = f"""
WITH items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {WORDS_SQL} AS ws FROM benchmark),
windows AS (
    SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[k:k + least(10, len(ws)) - 1], ' ') AS w
    FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS k FROM items WHERE len(ws) > 0)
),
docs AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
grams AS (
    SELECT doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS w
    FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM windows))
),
found AS (SELECT doc_id, k, n, item FROM grams JOIN windows USING (n, w)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
which AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN which USING (doc_id)
"""


@query("op9_language_id")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 4) == 2
    model = language.train(docs.filter(~held))
    return language.identify(docs, model, keep=("doc_id", held.alias("held_out")))


@query("op3_quality_classifier")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held = fold(F.col("doc_id"), 5) == 0
    model = quality.train(docs.filter(~held), table(spark, folder, "labels"))
    return quality.classify(docs, model, keep=("doc_id", held.alias("held_out")))


@query("op2_byte_bpe")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), bpe.public_vocabulary()).drop("ids")


@query("op1_vector_search")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


@query("op6_warc_packages")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    packages = archive.archive_pages(table(spark, folder, "pages"))
    return archive.read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op6_warc_packages"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first
    FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to
FROM m
"""


@query("op4_secret_scan")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.span_table(table(spark, folder, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random")


@query("op8_substring_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.repeats(table(spark, folder, "documents"), texts=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op8_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, k, list_aggregate(ws[k:k + 34], 'string_agg', ' ') AS words FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS k FROM d)),
h AS (SELECT doc_id, k, md5_number(words) AS h FROM w),
twice AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS p FROM h JOIN twice USING (h)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS words, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op7_lm_scoring")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    held = fold(F.col("doc_id"), 5) == 1
    return mixing.score(table(spark, folder, "documents"), ~held, keep=("doc_id", held.alias("held_out")))


# crc32 of a text's UTF-8 bytes, and its table by the rule of the reflected polynomial.
CRC_TABLE_SQL = """
steps AS (
    SELECT range AS i, list_reduce(list_prepend(range::UBIGINT, [1, 2, 3, 4, 5, 6, 7, 8]::UBIGINT[]),
        lambda c, step: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) AS c
    FROM range(256)
),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps)"""


def crc_sql(text: str, table: str = "t") -> str:
    """crc32 of the text in SQL, by bytes from its hex digits; ``table`` names the 256 entries."""
    return f"""xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(
        range(strlen({text})), lambda p: ('0x' || substr(hex(encode({text})), 2 * p + 1, 2))::UBIGINT)),
        lambda c, b: xor(c // 256, {table}[(xor(c % 256, b) + 1)::BIGINT])))"""


@query("op11_importance_resampling")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


ORACLES["op11_importance_resampling"] = f"""
WITH {CRC_TABLE_SQL.strip()},
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS ws FROM documents),
b AS (SELECT {WORDS_SQL} AS ws FROM benchmark),
df AS (SELECT r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]))) AS f FROM b),
each AS (SELECT f, {crc_sql("f")} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), crc_table),
s AS (SELECT bucket, count(*) AS n FROM df JOIN each USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN each USING (f) GROUP BY bucket),
gain AS (
    SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM df) + 10000)
        / ((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM bf) + 10000))))::BIGINT AS g
    FROM s FULL JOIN t USING (bucket)
),
w AS (SELECT r, floor(sum(g) / count(*))::BIGINT AS weight FROM df JOIN each USING (f) JOIN gain USING (bucket) GROUP BY r),
scored AS (
    SELECT r, doc_id, len(ws)::BIGINT AS n_words, (len(ws) + greatest(len(ws) - 1, 0))::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
            / 4294967296)))::BIGINT AS score
    FROM d LEFT JOIN w USING (r)
),
placed AS (
    SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank, n_words
FROM scored LEFT JOIN placed USING (r)
"""


@query("op12_source_mix")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixture.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


# One round of clamping per source at most; the fill goes through a source's next 4,096 documents one by one.
ORACLES["op12_source_mix"] = r"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+'))::BIGINT AS size,
        ('0x' || substr(md5('12:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS draw
    FROM documents
),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i,
        [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight
    FROM d GROUP BY source
),
level AS (
    SELECT 0 AS round, 0::DOUBLE AS lvl
    UNION ALL
    SELECT round + 1, next FROM (
        SELECT round, lvl, (sum(source_size)::DOUBLE - coalesce(sum(source_size * 3.0::DOUBLE) FILTER (source_size * 3.0::DOUBLE < lvl * weight), 0))
            / (sum(weight) FILTER (source_size * 3.0::DOUBLE >= lvl * weight)) AS next
        FROM level, s GROUP BY round, lvl
    ) WHERE next IS NOT NULL AND next <> lvl AND round <= (SELECT count(*) FROM s)
),
aim AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole
    FROM (SELECT s.*, least(source_size * 3.0::DOUBLE, (SELECT max(lvl) FROM level) * weight) AS target FROM s)
),
laid AS (
    SELECT *, target - whole * source_size AS quota, row_number() OVER o AS place,
        (sum(size) OVER (PARTITION BY i ORDER BY draw, size, r ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
    FROM d JOIN aim ON d.source IS NOT DISTINCT FROM aim.source WINDOW o AS (PARTITION BY i ORDER BY draw, size, r)
),
ends AS (SELECT i, min(place) AS first, max(quota - before) AS gap FROM laid WHERE before + size > quota GROUP BY i),
near AS (
    SELECT laid.i, place, size, gap, row_number() OVER (PARTITION BY laid.i ORDER BY place) AS k
    FROM laid JOIN ends USING (i) WHERE place >= first AND place < first + 4096 AND size > 0 AND gap > 0
),
filled AS (
    SELECT DISTINCT i, 0::BIGINT AS k, gap, NULL::BIGINT AS taken FROM near
    UNION ALL
    SELECT f.i, f.k + 1, CASE WHEN n.size <= f.gap THEN f.gap - n.size ELSE f.gap END, CASE WHEN n.size <= f.gap THEN n.place END
    FROM filled f JOIN near n ON n.i = f.i AND n.k = f.k + 1
),
left_over AS (SELECT i, min(gap) AS gap FROM filled GROUP BY i),
last AS (
    SELECT near.i, arg_min(place, (size, place)) AS taken, min(size) AS size, any_value(left_over.gap) AS gap
    FROM near JOIN left_over USING (i) ANTI JOIN filled ON filled.i = near.i AND filled.taken = near.place GROUP BY near.i
),
extra AS (SELECT i, taken AS place FROM filled WHERE taken IS NOT NULL UNION ALL SELECT i, taken FROM last WHERE size < 2 * gap)
SELECT doc_id, size, source_size, target, (times * size)::BIGINT AS taken, source, times AS repeats
FROM (
    SELECT laid.* EXCLUDE (source_1), (whole + CASE WHEN (before + size <= quota AND size > 0) OR extra.place IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS times
    FROM laid LEFT JOIN extra ON extra.i = laid.i AND extra.place = laid.place
)
"""


@query("op13_spelling_variants")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return variants.group_variants(table(spark, folder, "documents"))


# Near words: one is the other less a letter, or both lose the letter at the same place and are equal then.
ORACLES["op13_spelling_variants"] = f"""
WITH RECURSIVE {CRC_TABLE_SQL.strip()},
d AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run
    FROM documents
),
runs AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS name, count(*) AS n FROM d GROUP BY ALL),
drawn AS (SELECT run, n, {crc_sql("name")} AS h FROM runs, crc_table),
each AS (SELECT n, CASE WHEN h % 97 = 0 THEN run[:(h % length(run))::BIGINT] || run[(h % length(run))::BIGINT + 2:] ELSE run END AS word FROM drawn),
v AS (SELECT word, sum(n)::BIGINT AS n FROM each WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, p, word[:p] || word[p + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS p FROM v)),
near AS (
    SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.rest = b.word
),
best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word),
chosen AS (SELECT near.word, n_near, most, min(other) AS other FROM near JOIN best ON near.word = best.word AND near.n = most GROUP BY ALL),
forms AS (
    SELECT v.word, CASE WHEN most >= 2 * v.n THEN other END AS form, v.n, coalesce(n_near, 0)::BIGINT AS n_near,
        CASE WHEN most >= 2 * v.n THEN most END::BIGINT AS form_n
    FROM v LEFT JOIN chosen ON chosen.word = v.word
),
walk AS (
    SELECT word, word AS at FROM v
    UNION ALL
    SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NOT NULL
),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
