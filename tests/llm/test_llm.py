"""The training-data operators against brute force, SQL, round trips and planted rows, and on awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import differences
from pyspark.sql import functions as F

from verisift.llm import bpe, chat, components, kdtree, langid, minhash, mixing, negatives, outliers, phrases, sharding
from verisift.llm import toxicity, urls, warc
from verisift.llm.queries import QUERIES, URL_RULES, crc_mod

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, rank int, mix string"


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")


def prose(rnd: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns whose names the operators use themselves."""
    rnd = random.Random(5)
    long = prose(rnd, 40_000)
    rows = [
        (1, None, "en", "a", 0, 1, 1, "x"),
        (2, "", None, None, 0, 1, 1, "x"),
        (3, " \n\t", "en", "a", 3, 1, 1, None),
        (4, long, "en", "a", len(long), 1, 1, "x"),
        (5, long, "en", "a", len(long), 1, 1, "x"),
        (6, long + " more", "de", None, 0, None, None, None),
        (7, "one two", "en", "b", 7, 1, 1, "x"),
        (7, "one two", "en", "b", 7, 1, 1, "x"),
        (8, "1234 5678 !!", "en", "b", 7, 1, 1, "x"),
        (None, "one two three four five six", "en", "b", 7, 1, 1, "x"),
        (10, "<|endoftext|> Ünï漢字 ΑΣ  <|startoftext|>x", None, "c", None, 1, 1, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_same_rows_as_sql(spark, sf_dir, name):
    build, sql = QUERIES[name]
    assert differences(build(spark, sf_dir), sql, sf_dir) == []


# 1: near duplicates ------------------------------------------------------------------------------------------------


def shingles(text: str | None, width: int) -> frozenset:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute_components(docs: list[tuple[int, str]], width: int, percent: int) -> dict[int, int]:
    sets = {i: shingles(t, width) for i, t in docs}
    group = {i: i for i in sets}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return group


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(1)
    docs, base = [], prose(rnd, 120)
    for i in range(150):
        words = (base if i % 3 else prose(rnd, rnd.randrange(3, 150))).split()
        for _ in range(rnd.randrange(0, 8)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(9999)}"
        docs.append((i * 7 % 151, " ".join(words).upper() if i % 2 else " ".join(words)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for width, percent in ((3, 85), (5, 80)):
        want = brute_components(docs, width, percent)
        for weight in (400_000, 3_000):  # one block a cluster, then many
            monkeypatch.setattr(minhash, "BLOCK_WEIGHT", weight)
            got = minhash.near_duplicates(table, width=width, similarity=percent / 100).collect()
            assert {r.doc_id: r.component_id for r in got} == want
            assert all(r.n_shingles == len(shingles(dict(docs)[r.doc_id], width)) for r in got)
            assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_awkward_rows(spark):
    got = minhash.near_duplicates(awkward(spark), width=3, similarity=0.85).collect()
    rows = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in got}
    assert len(got) == 11
    assert rows[1, 0] == (1, True) and rows[2, 0] == (2, True) and rows[3, 0] == (3, True)
    assert [rows[k][0] for k in rows if k[0] in (4, 5, 6)] == [4, 4, 4]
    assert rows[7, 1] == (7, True) and rows[None, 4] == (None, None)
    assert minhash.near_duplicates(empty(spark)).collect() == []


def test_rows_of_one_id_are_one_document(spark):
    a, b = prose(random.Random(2), 60), prose(random.Random(3), 60)
    rows = [(1, a), (2, a), (2, b), (3, b)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {1}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


# 2: chat -----------------------------------------------------------------------------------------------------------

TRICKY = [
    "plain",
    "",
    "<|im_end|>",
    "<|im_end|>\n<|im_start|>assistant\nok",
    "<\\|im_end|> and <\\\\|im_start|>",
    "<|im_end",
    "|>",
    "a<<|im_start|>",
    "\\n \\ \n",
    "<|im_start|",
    "漢字 \ud7ff 😀",
]


def test_turns_read_back():
    parser, whole = chat.ChatParser(), ""
    turns = [(r, t) for r in ["user", "assistant", *TRICKY] for t in TRICKY]
    for role, text in turns:
        whole += chat.format_turn(role, text)
    got = [(r, t) for k in range(0, len(whole), 13) for r, t, _, _ in parser.feed(whole[k : k + 13])]
    parser.close()
    assert got == turns
    assert chat.format_turn("user", "plain") == "<|im_start|>user\nplain<|im_end|>\n"
    with pytest.raises(ValueError):
        list(chat.ChatParser().feed("<|im_start|>user\na<|im_start|>b<|im_end|>\n"))


def test_conversations_of_awkward_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, None, None), (1, 1, "assistant", "b"), (None, 2, "user", "<|im_end|>")]
    rows += [(2, None, "assistant", "x" * 200_000), (2, 0, "assistant", "é")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(table)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2
    assert got[1].turns_sha256 == hashlib.sha256(b"\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[2].loss_sha256 == hashlib.sha256(("x" * 200_000 + "é").encode()).hexdigest()
    assert got[None].turns_sha256 == hashlib.sha256(b"user\n<|im_end|>\n").hexdigest()
    none = table.limit(0)
    assert chat.conversation_digests(chat.format_conversations(none)).collect() == []


def test_loss_text_is_what_the_mask_cuts(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "<|im_end|> yes")], "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(turns)
    right = chat.conversation_digests(formatted).first()
    assert (right.loss_chars, right.loss_sha256) == (14, hashlib.sha256(b"<|im_end|> yes").hexdigest())
    wrong = chat.conversation_digests(formatted.withColumn("loss_end", F.col("loss_end") - 1)).first()
    assert (wrong.loss_chars, wrong.turns_sha256) == (13, right.turns_sha256)


# 3: language -------------------------------------------------------------------------------------------------------


def test_gradients_of_the_network():
    network = langid.LanguageNetwork(["a", "b", "c"], seed=1)
    x = langid.windows_of([b"Hello wor", b"ab", "é1z".encode()], 9)
    y = np.array([0, 1, 2])

    def loss() -> float:
        p = network.position_probabilities(x)
        counts = langid._IN_LETTER[x]
        return float(-(np.log(p[:, np.arange(3), y]) * counts).sum() / counts.sum())

    grads = network._gradients(x, y)
    rnd = np.random.default_rng(0)
    for p, g in zip(network.parameters(), grads, strict=True):
        at = tuple(rnd.integers(0, s) for s in p.shape)
        at = (int(x[0, 0]), *at[1:]) if p.shape[0] == langid.PAD + 1 else at
        kept, step = p[at], np.float32(1e-2)
        p[at] = kept + step
        up = loss()
        p[at] = kept - step
        down = loss()
        p[at] = kept
        assert abs((up - down) / (2 * step) - g[at]) < 2e-3


def test_languages_are_told_apart(spark):
    rnd = random.Random(4)
    parts = {"xx": ["ka", "lo", "mi"], "yy": ["str", "eng", "urt"]}
    rows = [
        (i, " ".join("".join(rnd.choice(parts[lang]) for _ in range(3)) for _ in range(40)), lang)
        for i in range(120)
        for lang in [("xx", "yy")[i % 2]]
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify_languages(table, lambda i: crc_mod(i, 5) == 0).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.lang_score <= 1 for r in found)
    odd = langid.identify_languages(awkward(spark), lambda i: F.lit(False), learn_from=table).collect()
    by_id = {(r.doc_id, r.text): r.lang_pred for r in odd}
    assert len(odd) == 11 and [v for (i, _), v in by_id.items() if i in (1, 2, 3, 8)] == ["und"] * 4
    nothing = langid.identify_languages(empty(spark), lambda i: F.lit(False))
    assert nothing.collect() == []


# 4: toxicity -------------------------------------------------------------------------------------------------------


def test_toxic_texts_are_found(spark):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        words = prose(rnd, rnd.randrange(20, 120), 300).split()
        if i % 6 == 0:
            for _ in range(6):
                words.insert(rnd.randrange(len(words)), rnd.choice(["vile", "rotten", "nasty"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, marks, lambda i: crc_mod(i, 3) == 1).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.toxicity >= 0.7 for r in held if r.doc_id % 6 == 0]) > 0.95
    assert np.mean([r.toxicity >= 0.7 for r in held if r.doc_id % 6]) < 0.01
    odd = toxicity.score_toxicity(awkward(spark), marks, lambda i: crc_mod(i, 3) == 1).collect()
    assert len(odd) == 11 and all(0 <= r.toxicity <= 1 for r in odd)
    none = toxicity.score_toxicity(docs, marks.limit(0), lambda i: F.lit(False)).collect()
    assert {r.toxicity for r in none} == {0.0}


def test_continuations_count_once(spark):
    rows = [("a b a b", 0), ("a b a b", 0), ("c b", 0), ("c b", 1)]
    counts = toxicity.continuation_counts(spark.createDataFrame(rows, "text string, label int")).collect()
    # b follows a and c in class 0 and stands in three texts; a follows the start and b.
    assert Counter((r.n0, r.n1) for r in counts) == Counter({(2, 1): 1, (2, 0): 1, (1, 1): 1})


# 5: search ---------------------------------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 300)
    monkeypatch.setattr(kdtree, "LEAF_ROWS", 8)
    rnd = np.random.default_rng(7)
    vectors = rnd.normal(size=(900, 6)) * rnd.choice([0.01, 1, 3], size=(900, 1))
    vectors[300:600] = vectors[300]  # a third is one vector
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    bad = [(2000, None), (2050, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2100, [float("nan")] * 6), (None, rows[0][1])]
    table = spark.createDataFrame([*rows, *bad], "vec_id long, vector array<double>")
    got = {}
    for r in kdtree.top_k(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    whole = np.floor(256 * vectors).astype(np.int64)
    for q in range(0, 900, 50):
        scores = sorted((-int(whole[q] @ whole[c]), c) for c in range(900) if c != q)[:5]
        assert got[q] == {k + 1: (-s, c) for k, (s, c) in enumerate(scores)}
    assert set(got) == set(range(0, 900, 50))
    few = kdtree.top_k(table.filter("vec_id < 3"), F.col("vec_id") % 50 == 0).collect()
    assert len(few) == 2 and kdtree.top_k(table.limit(0), F.lit(True)).collect() == []


# 6: URLs -----------------------------------------------------------------------------------------------------------


def test_rules_and_model_of_urls(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(400):
        good = i % 2 == 0
        word = "".join(rnd.choice("abcde" if good else "vwxyz") for _ in range(6))
        rows.append((i, f"HTTP://{word}.{'com' if good else 'net'}/{'en' if good else 'fr'}/{word}?q=1"))
        rows.append((1000 + i, f"https://{word}.org/{word}"))
    odd = [None, "", "no scheme", "http://", "x://EXAMPLE.com/en/a", "http://www.example.com/en/", "http://a.com?/x"]
    rows += [(5000 + k, u) for k, u in enumerate(odd)] + [(5000, None)]
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    table = spark.createDataFrame(rows, "page_id long, url string")
    got = urls.judge_urls(table, rules).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    assert (by_id[0].rule, by_id[0].verdict, by_id[0].path[:4]) == ("com/", "allow", "/en/")
    assert (by_id[1].rule, by_id[1].verdict) == ("net/fr/", "block")
    assert (by_id[5004].host, by_id[5004].rule, by_id[5004].verdict) == ("example.com", "example.com/en/", "block")
    assert (by_id[5005].rule, by_id[5005].verdict) == ("www.example.com/en/", "allow")
    assert (by_id[5006].host, by_id[5006].path, by_id[5006].rule) == ("a.com", "", None)
    assert all((by_id[5000 + k].host, by_id[5000 + k].path, by_id[5000 + k].rule) == ("", "", None) for k in range(3))
    right = [by_id[1000 + i].verdict == ("allow" if i % 2 == 0 else "block") for i in range(400)]
    assert np.mean(right) > 0.95
    assert urls.judge_urls(table.limit(0), rules).collect() == []


def test_url_model_counts_every_key(spark):
    """Many distinct characters and slugs: the differences equal those of plain dictionaries of counts."""
    rnd = random.Random(18)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]
    texts = ["".join(rnd.choices(letters, k=24)) for _ in range(6000)]
    rows = [f"http://{t[:8]}.{'com/' if i % 2 else 'net/fr/'}{t[8:]}" for i, t in enumerate(texts)]
    rows += ["http://" + "".join(rnd.choices(letters, k=20)) + ".org/x" for _ in range(200)] + [rows[0], ""]
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    table = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = urls.judge_urls(table, rules).collect()
    part = F.pmod(F.xxhash64("url"), F.lit(urls.CALIBRATION)) == 0
    held = {r.url for r in table.filter(part).collect()}

    def parts(url):
        for i, char in enumerate(url):
            for order in range(5):
                yield order, ("\x02" + url)[max(0, i + 1 - order) : i + 1].rjust(order, "\0"), char

    counts = (Counter(), Counter())
    for url in {r.url: r.rule for r in got if r.rule is not None and r.url not in held}:
        label = int(".com/" in url)
        for _, context, char in parts(url):
            counts[label][context, char] += 1
            counts[label][context] += 1
    for r in rnd.sample(got, 300) + got[-3:]:
        total = 0.0
        for label, sign in ((1, 1), (0, -1)):
            for order, context, char in parts(r.url):
                p = 1 / 256 if order == 0 else p
                p = (counts[label][context, char] + urls.WEIGHT * p) / (counts[label][context] + urls.WEIGHT)
                total += sign * np.log(p) if order == 4 else 0
        assert r.difference == pytest.approx(total / max(1, len(r.url)), abs=1e-9)


# 7: quality --------------------------------------------------------------------------------------------------------


def brute_statistics(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words, seen, dup, covered = WORD.findall(text), set(), 0, set()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_statistics_and_outliers(spark):
    rnd = random.Random(9)
    rows = [(i, prose(rnd, 150, 5000), "en", "a") for i in range(200)]
    rows += [(1000 + i, " ".join(w + "%%&*" for w in prose(rnd, 150, 5000).split()), "en", "a") for i in range(20)]
    rows += [(2000, "same words here\n" * 60, "en", "a"), (2001, None, None, None), (2002, "", "en", None)]
    rows += [(2003, "A b  c\x85d\n\nA b  c\x85d\r\n x\u00a0y", None, "a")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.judge_quality(table).collect()}
    for ident, text, _, _ in rows:
        r = got[ident]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert all(got[i].kept for i in range(200))
    assert not any(got[1000 + i].kept for i in range(20))
    assert not any(got[i].kept for i in (2000, 2001, 2002, 2003))
    assert len(outliers.judge_quality(awkward(spark)).collect()) == 11
    assert outliers.judge_quality(empty(spark)).collect() == []


def test_moderate_outliers_are_found(spark):
    rnd = random.Random(19)

    def mixed(text: str, kind: int) -> str:
        words = text.split()
        if kind == 0:
            return " ".join(w + "%" * (i % 10 == 0) for i, w in enumerate(words))
        if kind == 1:
            return " ".join(w.upper() if i % 2 else w for i, w in enumerate(words))
        if kind == 2:
            return "\n".join(" ".join(words[:15] if k in (3, 6) else words[15 * k : 15 * k + 15]) for k in range(10))
        return " ".join(words[:135] + words[:15])

    rows = [(i, prose(rnd, 150, 5000), "en", "a") for i in range(400)]
    rows += [(1000 + i, mixed(prose(rnd, 150, 5000), i % 4), "en", "a") for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.judge_quality(table).collect()}
    assert not any(r.base_failed for r in got.values())
    rejected = [sum(not got[1000 + i].kept for i in range(kind, 80, 4)) for kind in range(4)]
    assert rejected == [20, 20, 20, 20]
    assert sum(not got[i].kept for i in range(400)) <= 2


# 8: mixing ---------------------------------------------------------------------------------------------------------


def test_mix_meets_targets_and_reruns_agree(spark):
    rnd = random.Random(10)
    rows = [(i, prose(rnd, rnd.randrange(0, 60)), ["b", "a", None, "c"][min(3, i % 9)]) for i in range(1500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(table)
    first = {r.doc_id: r.mix for r in mixed.collect()}
    again = {r.doc_id: r.mix for r in mixing.mix(table.repartition(7)).collect()}
    assert first == again
    sizes, taken, target = Counter(), Counter(), {}
    for ident, text, source in rows:
        m = first[ident]
        assert m.size == len(WORD.findall(text)) and m.taken in (0, m.size, 2 * m.size)
        sizes[source] += m.size
        taken[source] += m.taken
        target[source] = m.target
    assert all(first[i].source_size == sizes[s] for i, _, s in rows)
    total = 1.5 * sum(sizes.values())
    order, want, open_ = ["a", "b", "c", None], {}, total
    weight = dict(zip(order, (5, 2, 1, 5), strict=True))
    left = set(order)
    while left:
        full = {s for s in left if 2 * sizes[s] <= open_ * weight[s] / sum(weight[x] for x in left)}
        if not full:
            want |= {s: open_ * weight[s] / sum(weight[x] for x in left) for s in left}
            break
        want |= {s: 2 * sizes[s] for s in full}
        open_ -= sum(2 * sizes[s] for s in full)
        left -= full
    assert all(abs(want[s] - target[s]) < 1e-6 and abs(taken[s] - target[s]) <= 30 for s in order)
    assert mixing.repeat_by_mix(mixed).count() == sum(m.copies for m in first.values())


def test_mix_of_awkward_rows(spark):
    got = mixing.mix(awkward(spark), into="mix").collect()
    assert len(got) == 11 and "size" in got[0].asDict() and all(0 <= r.mix.taken <= 2 * r.mix.size for r in got)
    same = [r.mix.copies for r in got if r.doc_id == 7]
    assert same[0] == same[1]
    assert mixing.mix(empty(spark)).collect() == []


# 9: revisits -------------------------------------------------------------------------------------------------------


def test_revisits_find_the_latest_earlier_response(spark, monkeypatch):
    monkeypatch.setattr(warc, "SLOT", 5)
    rnd = random.Random(11)
    rows = []
    for i in range(300):
        kind = "response" if i % 3 == 0 else "revisit"
        uri = rnd.choice(["http://a.com/x", "HTTP://A.com:80/x#f", "http://b.com", None])
        headers = {"ETag": f"{'W/' if i % 2 else ''}{rnd.randrange(2)}", "Expires": str(i), "Content-Type": str(i)}
        rows.append((i, kind, uri, rnd.randrange(60), headers if i % 5 else None, f"p{i}" if kind == "response" else None))
    table = spark.createDataFrame(
        rows, "record_id long, kind string, target_uri string, t long, headers map<string,string>, payload string"
    ).withColumn("fetched", F.timestamp_seconds("t"))
    got = {r.record_id: r for r in warc.resolve_revisits(table).collect()}
    canon = {"http://a.com/x": "a", "HTTP://A.com:80/x#f": "a", "http://b.com": "b", None: None}
    full = [r for r in rows if r[1] == "response" and r[2]]
    for ident, kind, uri, t, headers, _ in rows:
        if kind == "response":
            continue
        before = [(r[3], r[0]) for r in full if canon[r[2]] == canon[uri] and r[3] < t and uri]
        want = max(before)[1] if before else None
        r = got[ident]
        assert r.response_id == want
        stored = rows[want][4] if want is not None else None
        if want is None:
            assert r.status == "no_response" and r.payload is None
        elif headers is None:
            assert r.status == "unverified" and r.payload == f"p{want}"
        elif stored and stored["ETag"].removeprefix("W/") == headers["ETag"].removeprefix("W/"):
            assert r.status == "validated" and r.headers["content-type"] == stored["Content-Type"]
            assert r.headers["expires"] == headers["Expires"]
        else:
            assert r.status == "mismatch" and r.headers["content-type"] == headers["Content-Type"]
    assert len(got) == 200 and warc.resolve_revisits(table.limit(0)).collect() == []


# 10: BPE -----------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, ours = Tokenizer.from_file(path), bpe.load(path)
    rnd = random.Random(12)
    alphabet = "aeinrstlodxéßñ漢ΣİﬁǺ \n\t'’09.,!?<|>  \x1c\x85"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(50))) for _ in range(4000)]
    texts += ["aaaa" * 40, "<|endoftext|>The<|startoftext|>", "<|endoftext|", "i'll they've 's", "the" * 500, "", " "]
    texts += [t.replace("</w>", "") for t in list(library.get_vocab())[::7]]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = ours.encode(text)
        assert ids.tolist() == want.ids
        if want.ids:
            assert ours.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_of_awkward_rows(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = bpe.round_trip(awkward(spark), path).collect()
    assert len(got) == 11
    for r in got:
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids
    assert bpe.round_trip(empty(spark), path).collect() == []


# Pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language_id", "near_duplicates", "source_mix", "bpe"]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_components(rows, 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, g in want.items() if i == g)
    assert kept.columns == docs.columns
    result = corpus_pipeline.run(spark, sf_dir)
    assert result.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < result.select("doc_id").distinct().count() <= len(set(want.values()))


def test_pipeline_takes_awkward_rows(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).collect()
        assert len(out) <= (22 if name == "source_mix" else 11)
        assert len(stage(spark, docs.limit(0), sf_dir).collect()) == 0


def test_languages_stay_where_none_is_known(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    # The only row with a language is one of those held out.
    held = docs.filter("doc_id = 6").unionByName(unknown.filter("doc_id IS NULL OR doc_id != 6"))
    assert held.filter(~(crc_mod(F.col("doc_id"), 5) == 0) & F.col("lang").isNotNull()).count() == 0
    for rows in (unknown, held):
        out = [r.doc_id for r in corpus_pipeline.keep_languages(spark, rows, sf_dir).collect()]
        assert sorted(out, key=str) == [10, 4, 5, 6, 7, 7, None]


# 11: hard negatives ------------------------------------------------------------------------------------------------


def test_residue_products_are_exact():
    rng = np.random.default_rng(0)
    for size, dims in ((200, 64), (10**6, 5), (2**40, 64), (3, 3000)):
        a, b = (rng.integers(-size, size, (n, dims)) for n in (4, 7))
        primes = negatives.residue_primes(dims, dims * size * size)
        got = negatives.ResidueMatrix(a, primes).scores(negatives.ResidueMatrix(b, primes))
        want = a.astype(object) @ b.astype(object).T
        assert all(int(g) == (int(w) + 2**63) % 2**64 - 2**63 for g, w in zip(got.ravel(), want.ravel(), strict=True))
        half = max(primes) // 2
        assert min(dims, negatives.DEPTH) * half * half < 2**24 and np.prod([int(p) for p in primes], dtype=object) > 2 * dims * size**2


def brute_negatives(rows, positives=5, keep=5):
    out = []
    anchors = {(i, lab, tuple(v)) for i, lab, v in rows if i % 4 == 0}
    for i, lab, v in anchors:
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, other) for j, other, w in rows if j != i and len(w) == len(v))
        near = [(-s, j) for s, j, other in scored if other == lab][:positives]
        for score, j in near:
            fit = [(-s, k) for s, k, other in scored if other != lab and 80 * score <= -100 * s <= 100 * score][:keep]
            out += [(i, j, rank, k, score, s) for rank, (s, k) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("chunk", [16_384, 7])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    rnd = random.Random(11)
    # Ties without end, copies that fill a third of the table, two lengths, repeated rows and ids with two vectors.
    rows = [(i, i % 3, [rnd.randrange(-2, 4) for _ in range(6 if i % 9 else 4)]) for i in range(90)]
    rows += [(200 + i, i % 2, [1, 2, 0, 1, 1, 0]) for i in range(45)]
    rows += [rows[4], rows[8], (8, 1, [3, 3, 3, 0, 0, 1])]
    bad = [(300, None, [1.0]), (304, 1, None), (308, 1, []), (312, 1, [1.0, None]), (316, 1, [float("nan")]), (None, 1, [1.0] * 6)]
    table = spark.createDataFrame(
        [(i, lab, [float(x) / 256 for x in v], "x", 1) for i, lab, v in rows] + [(*b, "x", 1) for b in bad],
        "vec_id long, label int, embedding array<double>, window string, rank int",
    )
    got = negatives.hard_negatives(table, F.col("vec_id") % 4 == 0, F.col("label")).collect()
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r[c] for c in columns) for r in got) == brute_negatives(rows)
    assert negatives.hard_negatives(table.limit(0), F.col("vec_id") % 4 == 0, F.col("label")).collect() == []


# 12: sharding ------------------------------------------------------------------------------------------------------


def test_shards_hold_every_source_in_proportion(spark):
    rnd = random.Random(12)
    rows = [(i, prose(rnd, rnd.randrange(9)), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(2_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.shard_rows(table, 16).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    sizes = Counter(r.shard for r in got)
    assert sorted(sizes) == list(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in sizes:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sizes[shard]))
    per_source = Counter((r.source, r.shard) for r in got)
    for source, n in Counter(s for _, _, s in rows).items():
        assert all(abs(per_source[source, shard] - n / 16) <= 2 for shard in range(16))
    texts = {i: t.encode() for i, t, _ in rows}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id])) for r in got)
    again = sharding.shard_rows(table.repartition(5), 16).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_shards_of_awkward_rows(spark, tmp_path):
    got = sharding.shard_rows(awkward(spark), 4).collect()
    assert Counter(r.doc_id for r in got) == Counter([1, 2, 3, 4, 5, 6, 7, 7, 8, None, 10])
    assert {(r.size, r.text_crc32) for r in got if r.doc_id in (1, 2)} == {(1, 0)}
    assert sorted(Counter(r.shard for r in got).values()) == [2, 3, 3, 3]
    assert sharding.shard_rows(empty(spark)).collect() == []
    few = sharding.shard_rows(awkward(spark).limit(3), 16).collect()
    assert len({r.shard for r in few}) == 3 and all(r.slot == 0 for r in few)
    # Extra columns with the operator's own names, and one row repeated until it fills most of the table.
    copies = awkward(spark).filter("doc_id = 7").limit(1).crossJoin(spark.range(40)).drop("id")
    table = awkward(spark).unionByName(copies).withColumn("shard", F.lit("own"))
    sharding.write_shards(table, str(tmp_path / "shards"), 4)
    written = spark.read.parquet(str(tmp_path / "shards"))
    assert written.count() == 51 and {r["count"] for r in written.groupBy("shard").count().collect()} == {12, 13}
    want = table.drop("shard").collect()
    have = written.select(*(c for c in table.columns if c != "shard")).collect()
    assert Counter(map(str, want)) == Counter(map(str, have))


# 13: phrases -------------------------------------------------------------------------------------------------------


def brute_phrases(docs, least, top):
    counts, words = {}, Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = [x for x in re.split("[\x20\x09]", piece) if x]
            words[lang] += len(w)
            for k in range(1, 6):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        big = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        inner = Counter()
        for p, a in big.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i : i + k]] = max(inner[p[i : i + k]], a)
        scored = []
        for p, a in big.items():
            if inner[p] < a:
                score, k = min((1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


PHRASE_COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("flush", [2_000_000, 200])
def test_phrases_equal_brute_force(spark, monkeypatch, flush):
    monkeypatch.setattr(phrases, "FLUSH_WORDS", flush)
    monkeypatch.setattr(phrases, "WORD_CACHE", flush)
    monkeypatch.setattr(phrases, "PHRASE_CACHE", flush)
    rnd = random.Random(13)
    passage = " ".join(f"p{i}" for i in range(30))
    docs = []
    for i in range(300):
        words = " ".join(f"W{min(rnd.randrange(30), rnd.randrange(30))}{rnd.choice(['', '', ',', '.', '  '])}" for _ in range(60))
        docs.append((f"{words}\n{passage}\t tail" if i % 4 == 0 else words, ("en", "de", None)[i % 3]))
    docs += [("a a a a a a a a", "en")] * 5 + [(None, "en"), ("", "fr"), (" ,. \n", "en"), ("Ünï ÜNÏ a\x1cb", "und")] * 6
    for parts in (1, 5):
        table = spark.createDataFrame(docs, "text string, lang string").repartition(parts)
        got = phrases.collocations(table, least=6, top=120).collect()
        assert sorted(tuple(r[c] for c in PHRASE_COLUMNS) for r in got) == brute_phrases(docs, 6, 120)
    long = {r.path_words for r in got if r.phrase.startswith("p1 ")}
    assert long <= {30, 31} or not long


def test_phrases_are_handed_on_by_few_tasks(spark):
    docs = [("one two three four five six", "en")] * 400
    low = np.full(phrases.MIN_CELLS // 8, 255, dtype=np.uint8)
    many = spark.createDataFrame(docs, "text string, lang string").repartition(100)
    counted = phrases._count_in_texts(many, low, low, 5)
    tasks = phrases.SPREAD * spark.sparkContext.defaultParallelism
    # Two runs of five words, and four that end with the text, from every task.
    assert counted.count() <= 6 * tasks < 600
    sums = {r.phrase: r.n for r in counted.groupBy("phrase").agg(F.sum("n").alias("n")).collect()}
    assert sums["one two three four five"] == 400 and sums["six"] == 400 and len(sums) == 6


def test_unary_paths_are_whole_passages(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    table = spark.createDataFrame([(passage, "en")] * 9 + [("p3 p4 p5", "en")] * 4, "text string, lang string")
    got = {r.phrase: r.path_words for r in phrases.collocations(table, least=3).collect()}
    # p3 p4 p5 stands alone too, so the runs around it part the passage.
    assert got["p10 p11 p12 p13 p14"] == 25 and got["p3 p4 p5"] is None
    assert len(got) == 22


def test_phrases_of_awkward_rows(spark):
    got = phrases.collocations(awkward(spark), least=2).collect()
    docs = [(r.text, r.lang) for r in awkward(spark).collect()]
    assert sorted(tuple(r[c] for c in PHRASE_COLUMNS) for r in got) == brute_phrases(docs, 2, 2000)
    assert phrases.collocations(empty(spark)).collect() == []


# Registered queries --------------------------------------------------------------------------------------------------


def test_registered_near_duplicates_equal_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op1_minhash_dedup"][0](spark, sf_dir).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(docs, 3, 85)


def test_registered_classifiers_on_rows_they_did_not_see(spark):
    """Accuracy and recall over the held-out rows of the larger table."""
    sf_dir = "/root/testdata/sf0.01"
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = [r for r in QUERIES["op3_language_id"][0](spark, sf_dir).collect() if r.held_out and known[r.doc_id]]
    right = sum(r.lang_pred == known[r.doc_id] for r in found)
    assert len(found) > 150 and right >= 0.97 * len(found)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = [r for r in QUERIES["op4_toxicity"][0](spark, sf_dir).collect() if r.held_out and toxic.get(r.doc_id) is not None]
    false_alarms = sum(r.predicted for r in judged if not toxic[r.doc_id])
    assert false_alarms <= 0.03 * sum(not toxic[r.doc_id] for r in judged)


@pytest.mark.parametrize("name", ["op6_url_filter", "op7_quality_rules", "op10_bpe"])
def test_registered_queries_give_a_row_per_row(spark, sf_dir, name):
    table, key = ("pages", "page_id") if name == "op6_url_filter" else ("documents", "doc_id")
    want = Counter(r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect())
    assert Counter(r[key] for r in QUERIES[name][0](spark, sf_dir).collect()) == want
