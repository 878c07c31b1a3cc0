"""Resampling, source mixing and spelling variants against brute force, and on awkward input."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from pyspark.sql import functions as F

from stayscope.llm import mixture, ordering, resample, variants
from stayscope.llm.queries import QUERIES
from stayscope.session import materialise

TINY = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, source string, size bigint, key string, `_row` string, `_place` string"
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and long texts, repeated rows, and columns named like the operators' own."""
    draw = random.Random(3)
    prose = "\n".join(" ".join(draw.choice(["alpha", "beta", "Gamma", "délta", "omega"]) for _ in range(9)) for _ in range(3000))
    rows = [
        (1, prose, "a"), (2, prose + " END", "a"), (3, None, "a"), (4, "", None), (5, "One, two\x0bthree\nfour", "b"), (5, "One, two\x0bthree\nfour", "b"),
        (None, None, None), (None, "x", "c"), (None, "x", "c"), (6, " \n\t ", "c"), (7, "ab" * 50_000, "b"), (8, "é漢字🎉 don't  stop\r\n", "d"),
        (9, " ".join(["word"] * 30), "B"), (10, " ".join(["word"] * 30), "B"), (11, "a\nb\n\nc\nd e\n" * 5, "a"),
    ]
    full = [(i, t, s, 1, "clash", "clash", "clash") for i, t, s in rows]
    return materialise(spark.createDataFrame(full, SCHEMA).repartition(3), "odd")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.read.parquet(f"{TINY}/documents.parquet")


def rows_of(frame, *columns):
    return [tuple(row) for row in frame.select(*columns).collect()]


# ---- places and running totals


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_running_totals_equal_a_plain_loop(spark, parts):
    draw = random.Random(parts)
    rows = [(0 if draw.random() < 0.6 else draw.randrange(5), draw.randrange(50), draw.randrange(9), i) for i in range(3000)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = materialise(spark.createDataFrame(rows, "g long, o long, v long, id long").repartition(5), "in")
        got = {r.id: (r._place, r._before) for r in ordering.running(df, "g", [F.col("o").desc(), F.col("id")], "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    place, total = collections.Counter(), collections.Counter()
    for g, _, v, i in sorted(rows, key=lambda r: (r[0], -r[1], r[3])):
        place[g] += 1
        assert got.pop(i) == (place[g], total[g])
        total[g] += v
    assert not got


# ---- importance resampling


def features(text, grams=2):
    words = LETTERS.findall(lower(text))
    return words, [" ".join(words[i: i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1)]


def brute_resample(rows, target, grams=2, buckets=10_000, share=(25, 100), least=20, seed=7):
    def hashed(text):
        return [zlib.crc32(f.encode()) % buckets for f in features(text, grams)[1]]

    s = collections.Counter(b for _, text in rows for b in hashed(text))
    t = collections.Counter(b for text in target for b in hashed(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for key, text in rows:
        found = hashed(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(features(text)[0]) >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(fit[: len(fit) * share[0] // share[1]])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=repr)


def test_resampling_equals_brute_force(spark, tiny):
    docs, target = rows_of(tiny, "doc_id", "text"), [t for (t,) in rows_of(spark.read.parquet(f"{TINY}/benchmark.parquet"), "text")]
    got = rows_of(QUERIES["op11_importance_resampling"](spark, TINY), "doc_id", "n_features", "weight", "score", "rank")
    assert sorted(got, key=repr) == brute_resample(docs, target)


@pytest.mark.parametrize("grams, buckets", [(1, 50), (3, 70_000), (4, 997)])
def test_runs_across_short_lines_and_other_orders(odd, grams, buckets):
    target = odd.filter("doc_id IN (5, 8, 11)")
    got = resample.resample(odd, target, grams=grams, buckets=buckets, share=(2, 3), least_words=2, seed=1)
    want = brute_resample(rows_of(odd, "doc_id", "text"), [t for (t,) in rows_of(target, "text")], grams, buckets, (2, 3), 2, 1)
    assert sorted(rows_of(got, "doc_id", "n_features", "weight", "score", "rank"), key=repr) == want


def test_a_distinct_line_is_kept_once(odd):
    lines = [" ".join(words) for (text,) in rows_of(odd, "text") for line in (text or "").split("\n") if (words := LETTERS.findall(lower(line)))]
    got = {bytes(r.digest): r.times for r in resample.distinct_lines(odd.selectExpr("doc_id AS key", "text"), 2, 100).collect()}
    assert got == {hashlib.md5(line.encode()).digest(): n for line, n in collections.Counter(lines).items()}


def test_frequent_and_rare_lines_weigh_alike(odd, monkeypatch):
    """The broadcast table of frequent lines and the join give the same sums."""
    target = odd.filter("doc_id = 8")
    hot = resample.resample(odd, target).collect()
    monkeypatch.setattr(resample, "HOT", 2)
    assert sorted(hot, key=repr) == sorted(resample.resample(odd, target).collect(), key=repr)


def test_resampling_of_empty_tables(odd, none):
    assert resample.resample(none, odd).count() == 0
    got = rows_of(resample.resample(odd, none), "doc_id", "n_features", "weight", "score", "rank")
    assert sorted(got, key=repr) == brute_resample(rows_of(odd, "doc_id", "text"), [])


# ---- mixing


def brute_mix(rows, weights=(1, 2, 3), epochs=3, seed=12):
    """Sequential clamping and a first-fit scan, source by source."""
    sized = [(key, source, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))) for key, text, source in rows]
    names = sorted({s for _, s, _ in sized}, key=lambda s: (s is None, s or ""))
    size = {n: sum(z for _, s, z in sized if s == n) for n in names}
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, open_, left = {}, set(names), sum(size.values())
    while open_:
        level = left / sum(weight[n] for n in open_)
        over = {n for n in open_ if level * weight[n] > epochs * size[n]}
        if not over:
            target |= {n: level * weight[n] for n in open_}
            break
        target |= {n: float(epochs * size[n]) for n in over}
        left -= sum(epochs * size[n] for n in over)
        open_ -= over
    out = []
    for n in names:
        order = sorted(
            ((int(hashlib.md5(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:15], 16), z, k) for k, s, z in sized if s == n), key=lambda r: r[:2]
        )
        whole = math.floor(target[n] / size[n]) if size[n] else 0
        gap = target[n] - whole * size[n]
        extra, rest = set(), []
        for i, (_, z, _) in enumerate(order):
            if z and z <= gap:
                gap -= z
                extra.add(i)
            elif z:
                rest.append((z, i))
        if rest and gap > 0 and min(rest)[0] < 2 * gap:
            extra.add(min(rest)[1])
        out += [(k, z, size[n], round(target[n], 6), (whole + (i in extra)) * z) for i, (_, z, k) in enumerate(order)]
    return sorted(out, key=repr)


def mixed_rows(frame):
    return sorted(((a, b, c, round(d, 6), e) for a, b, c, d, e in rows_of(frame, "doc_id", "size", "source_size", "target", "taken")), key=repr)


def test_mix_equals_brute_force(spark, tiny):
    got = mixed_rows(QUERIES["op12_source_mix"](spark, TINY))
    assert got == brute_mix(rows_of(tiny, "doc_id", "text", "source"))
    assert got == mixed_rows(QUERIES["op12_source_mix"](spark, TINY))  # reruns agree


def test_mix_of_awkward_rows(odd):
    assert mixed_rows(mixture.mix(odd)) == brute_mix(rows_of(odd, "doc_id", "text", "source"))


def test_clamping_cascades_and_totals_are_kept(spark):
    """One large source, many small ones: sharing the excess pushes further sources over their caps."""
    draw = random.Random(5)
    docs = [(i, "w " * draw.randrange(1, 40), f"s{draw.randrange(12):02d}" if i % 3 else "big") for i in range(2000)]
    docs += [(9000 + i, "w " * 10, f"tiny{i}") for i in range(9)]
    rows = mixture.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), weights=(1, 5)).collect()
    by = {r.source: r for r in rows}
    assert sum(r.target for r in by.values()) == pytest.approx(sum(r.size for r in rows))
    clamped = [r for r in by.values() if r.target == 3 * r.source_size]
    assert 9 <= len(clamped) < len(by) and all(r.target < 3 * r.source_size for r in by.values() if r not in clamped)
    for name, r in by.items():
        taken = sum(x.taken for x in rows if x.source == name)
        assert abs(taken - r.target) <= 20, name
    assert all(r.taken <= 3 * r.size and r.taken == r.repeats * r.size for r in rows)


def test_repeated_rows_of_one_key_are_split(spark):
    """A third of a source has no key and one text: the sample may take any number of these rows."""
    docs = spark.createDataFrame([(None, "a b c", "x")] * 600 + [(i, "d e", "x") for i in range(1200)] + [(9999, "z", "y")], "doc_id long, text string, source string")
    rows = mixture.mix(docs, weights=(3, 1)).collect()
    target = next(r.target for r in rows if r.source == "x")
    assert abs(sum(r.taken for r in rows if r.source == "x") - target) < 2


def test_repeating_rows_and_empty_mix(spark, none):
    assert mixture.mix(none).count() == 0
    docs = spark.createDataFrame([(1, "a b", "p"), (2, "c", "q"), (3, "", "q")], "doc_id long, text string, source string")
    mixed = materialise(mixture.mix(docs), "mixed")
    counts = collections.Counter(r.doc_id for r in mixture.repeat_rows(docs, mixed).collect())
    assert counts == {r.doc_id: r.repeats for r in mixed.collect() if r.repeats}


# ---- spelling variants


def brute_variants(rows, least_letters=5, least_count=3):
    counts = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_count}
    by_less = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_less[w[:i] + w[i + 1:]].add(w)
    near = {w: set() for w in words}
    for w in words:
        candidates = set(by_less.get(w, ())) | {v for i in range(len(w)) for v in by_less[w[:i] + w[i + 1:]]} | {w[:i] + w[i + 1:] for i in range(len(w))}
        near[w] = {v for v in candidates if v in words and edits(v, w) == 1}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_variants_equal_brute_force(spark, tiny):
    got = rows_of(QUERIES["op13_spelling_variants"](spark, TINY), "word", "form", "root", "n", "n_near", "form_n")
    want = brute_variants(rows_of(tiny, "doc_id", "text"))
    assert len(want) > 500 and sum(r[1] is not None for r in want) > 20 and sorted(got) == want


def test_variants_across_small_blocks(spark, monkeypatch):
    """Blocks of a few words and copies of blocks, words of few letters so that many are near, accents, very long words."""
    monkeypatch.setattr(variants, "BLOCK", 7)
    monkeypatch.setattr(variants, "CHUNK", 3)
    monkeypatch.setattr(variants, "EDGE", 4)
    draw = random.Random(11)
    long = "x" * 300
    pool = ["".join(draw.choice("abé") for _ in range(draw.randrange(4, 9))) for _ in range(300)] + [long, long + "y", "y" + long, long[:150] + "z" + long[151:]]
    docs = [(i, " ".join(draw.choices(pool, k=60))) for i in range(60)] + [(None, "Ébène abba"), (None, None), (77, "")] * 3
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted(rows_of(variants.group_variants(frame), "word", "form", "root", "n", "n_near", "form_n")) == brute_variants(docs)


def test_band_equals_the_full_matrix():
    draw = random.Random(2)
    words = sorted({"".join(draw.choice("ab") for _ in range(draw.randrange(2, 9))) for _ in range(400)})
    for query in words:
        fit = [w for w in words if -1 <= len(w) - len(query) <= 1]
        lcps = [0, *(variants.shared_prefix(a, b) for a, b in zip(fit, fit[1:]))]
        want = [i for i, w in enumerate(fit) if w[:2] == query[:2] and edits(w, query) == 1]
        assert variants.near_in_list(fit, lcps, query, 2) == want
        for other in words[::7]:
            assert variants.within_one(other, query) == any(edits(other, query[:n]) <= 1 for n in range(len(query) + 1))


def test_chains_of_forms_reach_their_root(spark):
    rows = []
    chain = ["aaaaaaaa"[:8 - i] + "b" * i for i in range(9)]
    for i, w in enumerate(chain):
        rows += [(None, w)] * (3 * 2 ** i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: r.root for r in variants.group_variants(docs, one_in=0).collect()}
    assert got == {w: "b" * 8 for w in chain}


def test_variants_of_awkward_rows(odd, none):
    assert variants.group_variants(none).count() == 0
    got = rows_of(variants.group_variants(odd), "word", "form", "root", "n", "n_near", "form_n")
    assert sorted(got, key=repr) == sorted(brute_variants(rows_of(odd, "doc_id", "text")), key=repr)


# ---- mends of earlier operators


def test_number_signs_end_a_run_of_letters():
    from stayscope.llm import language

    assert language.words_of("½cup of x²y, Ⅷth 3rd naïve") == ["cup", "of", "x", "y", "th", "rd", "naïve"]


def test_a_text_that_begins_with_a_fraction_has_a_language(spark):
    from stayscope.llm import language

    docs = spark.createDataFrame([(1, "a cup of tea", "en"), (2, "une tasse de thé", "fr")] * 5, "doc_id long, text string, lang string")
    model = language.train(docs)
    asked = spark.createDataFrame([(1, "½cup", None), (2, "½ 3", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(asked, model, keep=("doc_id",)).collect()}
    assert got[1] in ("en", "fr") and got[2] == "und"


def test_ends_outside_the_listed_words_are_counted(spark, monkeypatch):
    """Texts so long that their ends are rarer than the listed words."""
    from stayscope.llm import mixing

    monkeypatch.setattr(mixing, "VOCABULARY", 2)
    texts = ["one two " * 40 + "three", "one two " * 30 + "four four"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = collections.Counter(w for t in texts for w in [*t.split(), "\n"])
    n, v = sum(counts.values()), len(counts)
    for r in mixing.score(docs, F.lit(True)).collect():
        tokens = [*texts[r.doc_id].split(), "\n"]
        assert r.n_known == r.n_tokens == len(tokens) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))


def test_packages_are_read_by_many_tasks(spark):
    from stayscope.llm import archive

    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 50) for i in range(60)], "page_id long, url string, html string")
    packages = archive.archive_pages(pages.filter("page_id < 30"))
    for low in (30, 40, 50):
        packages = packages.unionByName(archive.archive_pages(pages.filter(f"page_id >= {low} and page_id < {low + 10}")))
    read = archive.read_packages(packages)
    assert packages.count() >= 4 and read.rdd.getNumPartitions() == packages.count()
    assert sorted(r.page_id for r in read.collect()) == list(range(60))
