"""The queries as they are registered: against plain Python over a whole small table, on odd rows and on clashing columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from waymark.llm import common, decontaminate, language_id, line_dedup, near_dedup, ngram_lm, quality_rules, toxicity
from waymark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, SF).collect()}


def crc(x):
    return zlib.crc32(str(x).encode())


def test_op2(spark, docs):
    """Naive Bayes by dictionaries over the same hashed n-grams gives the same answers."""
    sums, prior = {}, Counter()
    for k, r in docs.items():
        if crc(k) % 5 and r["lang"] is not None and (x := language_id.buckets(r["text"] or "")) is not None:
            sums.setdefault(r["lang"], Counter()).update(x.tolist())
            prior[r["lang"]] += 1
    total = {c: sum(s.values()) + 0.5 * language_id.BUCKETS for c, s in sums.items()}
    got = run(spark, "op2_language_id")
    assert got.keys() == docs.keys()
    right = []
    for k, r in docs.items():
        x = language_id.buckets(r["text"] or "")
        assert got[k]["held_out"] == (crc(k) % 5 == 0)
        if x is None:
            assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0)
            continue
        log = {c: math.log(prior[c] / sum(prior.values())) + sum(n * math.log((s[b] + 0.5) / total[c]) for b, n in Counter(x.tolist()).items()) for c, s in sums.items()}
        best = max(sorted(log), key=log.get)
        assert got[k]["lang_pred"] == best
        assert math.isclose(got[k]["score"], 1 / sum(math.exp(min(700, v - log[best])) for v in log.values()), abs_tol=1e-3)
        if got[k]["held_out"] and r["lang"]:
            right.append(best == r["lang"])
    assert np.mean(right) >= 0.9


def test_op4(spark, docs):
    """Every item against every text by the plain recurrence of the edit distance."""
    items = {r["item_id"]: decontaminate.folded(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}

    def distance(a, t):
        """The least distance of a from any part of t, a row of numbers at a time."""
        codes, row = np.array([*map(ord, t)]), np.zeros(len(t) + 1, np.int64)
        at = np.arange(len(t) + 1)
        for i, c in enumerate(a):
            new = np.empty_like(row)
            new[0] = i + 1
            new[1:] = np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)
            row = np.minimum.accumulate(new - at) + at
        return int(row.min())

    some = sorted(docs)[::6]
    got = run(spark, "op4_benchmark_decontamination")
    names = {}
    for i, t in sorted(items.items(), reverse=True):
        names[t] = i
    for k in some:
        text = decontaminate.folded(docs[k]["text"])
        want = {i: d for t, i in names.items() if len(text) < 3000 and text and (d := distance(t, text)) <= int(len(t) * decontaminate.ERROR_RATE)}
        if len(text) < 3000:
            found = dict(map(int, x.split(":")) for x in filter(None, got[k]["items"].split(",")))
            assert found.keys() == want.keys() and all(found[i] >= want[i] for i in found)
            assert got[k]["contaminated"] == bool(want) and got[k]["n_items"] == len(want)
    assert any(r["contaminated"] for r in got.values()) and got.keys() == docs.keys()


def test_op5(spark, docs):
    """Base counts by plain Python, and the verdict from references counted by dictionaries."""
    langs = {}
    base = {}
    for k, r in docs.items():
        text = r["text"] or ""
        words = WORD.findall(text)
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        repeat = len({j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)})
        lines = [x for x in text.split("\n") if WORD.search(x)]
        base[k] = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len({*lines}), repeat)
        failed = len(words) < 10 or 100 * repeat > 20 * len(words)
        if not failed and r["lang"]:
            words_of, classes = langs.setdefault(r["lang"], (Counter(), np.zeros(quality_rules.CLASSES)))
            words_of.update(text.encode().lower().split())
            classes += quality_rules.class_counts(text.encode())
    refs = {}
    for lang, (count, classes) in langs.items():
        n = sum(count.values())
        refs[lang] = classes / classes.sum(), {w: c / n for w, c in count.items() if c >= n * quality_rules.COMMON_SHARE}

    def js(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q)]
        return math.sqrt(max(0, sum(x * math.log2(x / z) for x, z in zip([*p, *q], [*m, *m]) if x > 0) / 2))

    got = run(spark, "op5_quality_rules")
    assert got.keys() == docs.keys()
    for k, r in docs.items():
        raw = (r["text"] or "").encode()
        low = raw.lower().split()
        row = got[k]
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base[k]
        failed = base[k][0] < 10 or 100 * base[k][4] > 20 * base[k][0]
        by_word = by_class = None
        if len(low) >= quality_rules.MIN_WORDS:
            by_word = {}
            for lang, (_, common_) in refs.items():
                mine = Counter(w for w in low if w in common_)
                p = [mine[w] / len(low) for w in common_]
                by_word[lang] = js([*common_.values(), 1 - sum(common_.values())], [*p, 1 - sum(p)])
        if len(raw) >= quality_rules.MIN_BYTES:
            c = quality_rules.class_counts(raw)
            by_class = {lang: js(ref[0], c / c.sum()) for lang, ref in refs.items()}
        nearest = min(by_word or by_class, key=(by_word or by_class).get) if by_word or by_class else None
        if by_word:
            assert math.isclose(row["word_distance"], by_word[nearest], abs_tol=1e-6)
        keep = not failed and (not by_class or by_class[nearest] <= quality_rules.MAX_CLASS_DISTANCE) and (not by_word or by_word[nearest] <= quality_rules.MAX_WORD_DISTANCE)
        assert (row["base_failed"], row["kept"]) == (failed, keep)


def test_op7(spark, docs):
    train = [w for k, r in docs.items() if crc(k) % 7 != 2 for w in [*(r["text"] or "").encode().lower().split(), b" "]]
    count = Counter(train)
    got = run(spark, "op7_lm_scoring")
    assert got.keys() == docs.keys()
    for k, r in docs.items():
        x = [*(r["text"] or "").encode().lower().split(), b" "]
        assert (got[k]["held_out"], got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"]) == (crc(k) % 7 == 2, len(x), sum(w in count for w in x), len(train))
        assert math.isclose(got[k]["base_score"], sum(math.log10((count[w] + 1) / (len(train) + len(count) + 1)) for w in x), rel_tol=1e-9)
        assert got[k]["score"] > got[k]["base_score"] or got[k]["held_out"]


def test_op9(spark, docs):
    """Counting and calibrating by Spark is learning by hand from the same rows."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = run(spark, "op9_toxicity")
    m = toxicity.Model([(docs[k]["text"], y) for k, y in labels.items() if y is not None and k in docs and crc(k) % 3 != 1])
    assert got.keys() == docs.keys()
    for k, r in docs.items():
        words = toxicity.TOKEN.findall((r["text"] or "").lower())
        assert math.isclose(got[k]["score"], m.score(m.evidence(words)), abs_tol=1e-9)
        assert got[k]["held_out"] == (crc(k) % 3 == 1) and got[k]["predicted"] == int(got[k]["score"] >= 0.7)


def test_sums_of_segments():
    """More segments are more evidence; one alone counts as itself, and the order is nothing."""
    m = toxicity.Model()
    one, two = [(6.0, 0, 1)], [(6.0, 0, 1), (5.5, 3, 4)]
    assert m.evidence([], one) == 6.0 and m.evidence([], two) > 7 and m.evidence([], two) == m.evidence([], two[::-1])
    assert m.evidence([], [(-2.0, 0, 1), (-3.0, 3, 4)]) == -2.0


ODD = [(1, None), (2, ""), (3, "x"), (4, "\n \n\t"), (5, "one two three four five six seven eight nine ten eleven"), (5, "one two three four five six seven eight nine ten eleven"), (6, "é " * 60), (None, "one two three four five six seven eight nine ten eleven"), (7, "long " * 40_000)]
CLASHES = "deleted_lines string, score double, found string, h string, node string, d string, row string, kept string, held_out string, _wm_d string, size string"


@pytest.fixture(scope="module")
def odd(spark):
    names = [x.split()[0] for x in CLASHES.split(", ")]
    rows = [(i, t, "en", "s", None, *((0.5 if n == "score" else f"own {n}") for n in names)) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES)


def test_odd_rows_have_defined_results(spark, odd):
    key = lambda rows, *cols: sorted(((r["doc_id"] is None, r["doc_id"] or 0, *(r[c] for c in cols)) for r in rows), key=str)
    got = {r["doc_id"]: r for r in language_id.identify(odd).collect()}
    assert {k for k, r in got.items() if r["lang_pred"] == "und"} == {1, 2, 4} and got[7]["lang_pred"] == "en"
    got = quality_rules.assess(odd).collect()
    assert key(got, "n_words", "base_failed") == key([dict(doc_id=i, n_words=len((t or "").split()), base_failed=i not in (None, 5)) for i, t in ODD], "n_words", "base_failed")
    got = near_dedup.cluster(odd).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 0, 4, True), (5, 9, 5, True), (6, 1, 6, True), (7, 1, 7, True), (None, 9, None, True)} and len(got) == len(ODD)
    bench = spark.createDataFrame([(9, "SEVEN eight  nine ten"), (8, "seven eight nine ten"), (3, None), (None, "x"), (4, " ")], "item_id long, text string")
    got = decontaminate.scan(odd, bench).collect()
    assert {(r["doc_id"], r["items"]) for r in got if r["contaminated"]} == {(5, "8:0"), (None, "8:0")} and len(got) == len(ODD)
    kept = decontaminate.without(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 3
    got = ngram_lm.scored(odd).collect()
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 4)} == {1} and len(got) == len(ODD)
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    scored = toxicity.with_score(odd, toxicity.train(toxicity.sample(odd, labels)), common.fresh(odd, "score"))
    assert scored.columns == [*odd.columns, "score_"] and scored.count() == len(ODD)


def test_line_dedup_keeps_columns(spark, odd):
    run_ = "\n".join(f"line {k} of a run that stands in two texts" for k in range(8))
    rows = [(20, f"a\n{run_}\nb", "own", "x"), (21, f"c\n{run_}", "own", "y"), (21, f"c\n{run_}", "own", "y"), (21, "another text", "own", "z"), (22, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, deleted_lines string, d string")
    out = line_dedup.dedup(df)
    assert out.columns == ["doc_id", "text", "deleted_lines", "d", "deleted_lines_"]
    got = {(r["doc_id"], r["d"]): (r["text"], r["deleted_lines"], r["deleted_lines_"]) for r in out.collect()}
    assert out.count() == 5 and got == {(20, "x"): (rows[0][1], "own", []), (21, "y"): ("c", "own", [*range(1, 9)]), (21, "z"): ("another text", "own", []), (22, None): (None, None, [])}
    assert line_dedup.dedup(odd).drop("deleted_lines_").columns == odd.columns


def test_line_dedup_of_long_documents(spark):
    """Repeated and shuffled lines, 20,000 in a document, by brute force over runs of lines."""
    rng = random.Random(3)
    pool = [f"w{k} x{k}" for k in range(300)]
    texts = ["\n".join(["the same line"] * 20_000), "\n".join(rng.choice(pool) for _ in range(20_000))]
    texts.append(texts[1] + "\nend")
    seen, want = set(), []
    for text in texts:
        lines, gone, need = text.split("\n"), set(), 50
        for a in range(len(lines)):
            n = words = 0
            while words < need and a + n < len(lines):
                words += len(lines[a + n].split())
                n += 1
            if words < need:
                break
            name = tuple(lines[a : a + n])
            if name in seen:
                gone.update(range(a, a + n))
            seen.add(name)
        want.append(len(lines) - len(gone))
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: len(r["text"].split("\n")) for r in line_dedup.dedup(rows).collect()}
    assert got == dict(enumerate(want))


def test_blocks_of_a_benchmark(spark, monkeypatch):
    """Several blocks give what one gives."""
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    items = [(k, say(12)) for k in range(9)] + [(20, "")]
    items.append((30, items[2][1].upper()))
    rows = [(k, f"{say(9)} {rng.choice(items)[1]} {say(9)} {rng.choice(items)[1]}") for k in range(30)] + [(3, "x"), (None, items[0][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    read = lambda: sorted(((r["doc_id"], r["items"], r["n_items"]) for r in decontaminate.scan(docs, bench).collect()), key=str)
    one = read()
    blocks = decontaminate.blocks
    monkeypatch.setattr(decontaminate, "blocks", lambda b: blocks(b, 100))
    assert len([*decontaminate.blocks(bench)]) > 3 and read() == one and sum(bool(x[1]) for x in one) > 15


def test_hot_groups_are_joined_whole(spark):
    rows = spark.createDataFrame([(k % 3 if k < 3000 else k, k) for k in range(9000)], "key long, v long")
    groups = rows.groupBy("key").count().withColumnRenamed("count", "m").selectExpr("key", "m", "key * 2 as twice")
    got = common.joined(rows, groups, ["key"], "m", 100)
    assert got.columns == ["key", "v", "twice"] and got.count() == 9000 and got.where("twice <> 2 * key").count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master = "yarn"
        getConf = staticmethod(lambda: Conf)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_pipeline_judges_rows_by_their_text(spark, tmp_path):
    """Extra and clashing columns, null keys, one doc_id with two texts, repeated rows, empty tables."""
    import corpus_pipeline

    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice("klmn") for _ in range(n))
    a, b = say(80), say(80)
    rows = [(1, a, "own", 1), (2, a, "own", 2), (2, b, "own", 3), (3, say(80), "own", 4), (3, say(80), "own", 5), (4, None, "own", 6), (None, say(80), "own", 7), (5, b + " end", "own", 8)]
    schema = "doc_id long, text string, deleted_lines string, n int"
    bench, labels = "item_id long, text string", "doc_id long, toxic int"
    for name, df in (("documents", spark.createDataFrame(rows, schema)), ("benchmark", spark.createDataFrame([], bench)), ("labels", spark.createDataFrame([], labels))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = common.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "deleted_lines", "n"]
    assert {r["n"] for r in docs.collect()} == {1, 3, 4, 5, 6, 7} and all(r["deleted_lines"] == "own" for r in docs.collect())
    empty = tmp_path / "empty"
    for name, s in (("documents", schema), ("benchmark", bench), ("labels", labels)):
        spark.createDataFrame([], s).write.parquet(str(empty / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
