"""Problems 1, 2, 7 and 8: brute force, held-out accuracy, edge cases."""

import random
from pathlib import Path

import numpy as np
import pytest

from weftline.llm import leakage, prose, reading, tokens
from weftline.llm.textnorm import words

CATALOG = "source_name string, lang string, domain string"
RECORDS = "rec_id bigint, text string, _source string, split string, lang string, tails string, __text string"


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([("engmix_a-01.jsonl", "en", "web"), ("hebmix_b-01.jsonl", "he", None), ("codemix_c-01.jsonl", "code", "github")], CATALOG)


PROSE_EN = "The old farmer carried the basket to the market and sold it to a child who had waited there since the morning. After that he went home along the river."
PROSE_HE = "האיכר הזקן נשא את הסל אל השוק ומכר אותו לילד שחיכה שם מאז הבוקר. לאחר מכן הוא הלך לבית של אחיו ליד הנהר ואכל את הלחם עם המלח."


def corpus():
    """Different prose of two languages, from which the common words of a test's texts are learned."""
    r = random.Random(12)
    en = "farmer basket market child morning home river road house bread salt boat stone hill tree horse letter window garden coat lamp bridge mill field clock tower shelf kettle pocket sailor tailor meadow copper ladder carpet engine barrel needle button cellar saddle ticket island forest candle".split()
    he = "האיכר הסל השוק הילד הבוקר הבית הנהר הדרך הלחם המלח הסירה האבן הגבעה העץ הסוס המכתב החלון הגן המעיל המנורה הגשר הטחנה השדה השעון המגדל המדף הקומקום הכיס המלח החייט האחו הנחושת הסולם השטיח המנוע החבית המחט הכפתור המרתף האוכף הכרטיס האי היער הנר".split()
    sentence_en = lambda: "The {} was seen by the {} of the {}, and after the {} it went to the {}.".format(*r.sample(en, 5)).capitalize()
    sentence_he = lambda: "{} הלך אל {} של {} לאחר {} וגם מצא את {}.".format(*r.sample(he, 5))
    return [" ".join((sentence_en if i % 2 else sentence_he)() for _ in range(1)) for i in range(160)]


JUNK = [
    "\n".join(f"* item{i} basket ({i})" for i in range(30)),
    "\n".join(f"river\t{i}.5\t{i * 7}\tbasket" for i in range(20)),
    "home | about | river basket | contact | shop | news",
    "basket market river child morning farmer bread salt house road " * 4,
    "<td class='x'>river</td><td class='y'>basket</td>" * 10,
    "2020-01-01T10:00:00 WARN [river] code=17 dur=5ms\n" * 8,
    "venlKn9X5hOTMoAayc9lb+1IDlHS/3xGNhV4HKOqdICVnkYpsDInm4+23uA2q4wuEWcb7+gaI6IWGxoXny",
    "The old farmer carried the basket to the market. " * 20,
    "]!:9 !:</0.5;}~#>0 +0/#![&>: 2=}1]5 -6*2;_ /*8]18 %@;83$4:",
    "Gredod »",
    "Basket river.\nMarket bread.\nChild.\nRoad house salt.",
]


def test_prose_and_junk(spark, catalog):
    rows = [(i, PROSE_EN if i % 2 else PROSE_HE, "engmix_a-01.jsonl", "train", "x", "y", "z") for i in range(40)]
    rows += [(100, PROSE_EN.upper(), " ENGMIX_A-01.JSONL ", None, None, None, None), (101, PROSE_EN.replace(" ", "\n"), None, None, None, None, None), (102, PROSE_HE.replace(".", ""), "data/hebmix_b-01", None, None, None, None)]
    rows += [(103, "\n".join("- " + s for s in [PROSE_EN] * 1 + ["The child saw the river and went to it."]), "engmix_a-01", None, None, None, None)]
    rows += [(200 + i, t, "engmix_a-01.jsonl", "train", "x", "y", "z") for i, t in enumerate(JUNK)]
    rows += [(300, JUNK[0], "CODEMIX_C-01.jsonl ", None, None, None, None), (301, None, None, None, None, None, None), (302, " \n\t ", None, None, None, None, None), (303, "", None, None, None, None, None), (None, JUNK[0], None, None, None, None, None)]
    rows += [(304, JUNK[3] * 5000, "codemix_z-77", None, None, None, None), (305, PROSE_EN + " " + " ".join(f"the {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6] * (i // 600 % 9)} of it went" for i in range(5000)), None, None, None, None, None)]
    rows.append(rows[-6])  # delivered twice
    rows += [(1000 + i, t, "engmix_a-01.jsonl", "train", "x", "y", "z") for i, t in enumerate(corpus())]
    df = spark.createDataFrame(rows, RECORDS)
    found = sorted(r["rec_id"] for r in prose.not_prose(df, catalog).collect())
    assert found == [200 + i for i in range(len(JUNK))]
    one = {r["rec_id"]: r for r in prose.record_quality(df, catalog).collect()}
    assert one[300]["lang"] == "code" and one[300]["is_prose"] is None and one[304]["lang"] == "code"
    assert not {301, 302, 303, None} & set(one)
    assert 0 <= one[1]["pct_n_words"] <= 100 and one[1]["source"] == "engmix_a-01.jsonl"


FOREIGN = [
    "Le vieux fermier portait le panier au marché et le vendit à un enfant qui attendait là depuis le matin. Après cela, il rentra chez lui le long de la rivière et il mangea du pain avec du sel.",
    "Der alte Bauer trug den Korb auf den Markt und verkaufte ihn an ein Kind, das dort seit dem Morgen gewartet hatte. Danach ging er am Fluss entlang nach Hause und aß das Brot mit dem Salz, das er in der Stadt gekauft hatte.",
    "Старый крестьянин нёс корзину на рынок и продал её ребёнку, который ждал там с самого утра. Потом он пошёл домой вдоль реки и съел хлеб с солью, который он купил в городе у брата.",
]
WRONG_ENCODING = "÷öá æåì øöä àú äø÷ãï äùèåç àì äîèáç äôéæéåìåâéú. äçîàä äòîå÷ çúí äúé÷ îï äàøåáä äøçå÷. äàáï äîìà äöéò àú äëì àì äáéú îï äùåê."


def test_prose_of_languages_without_known_words(spark, catalog):
    rows = [(i, PROSE_EN if i % 2 else PROSE_HE, None, None, None, None, None) for i in range(60)]
    rows += [(100 + i, t, None, None, None, None, None) for i, t in enumerate(FOREIGN)]
    rows += [(1000 + i, t, None, None, None, None, None) for i, t in enumerate(corpus())]
    rows += [(200, WRONG_ENCODING, None, None, None, None, None), (201, " ".join(JUNK[3].split() * 3), None, None, None, None, None)]
    found = sorted(r["rec_id"] for r in prose.not_prose(spark.createDataFrame(rows, RECORDS), catalog).collect())
    assert found == [200, 201]


def test_common_words_come_from_the_texts(spark, monkeypatch):
    r = random.Random(3)
    texts = [" ".join([f"bli{r.randrange(5000)}" if r.random() < 0.7 else r.choice(["zu", "wo"]) for _ in range(40)]) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",), ("zu {} = [] <> ;" * 9,)], "text string")
    assert prose.common_words(df) == {"zu", "wo"}
    monkeypatch.setattr(prose, "COUNTERS", 50)
    monkeypatch.setattr(prose, "KEPT", 10)
    assert prose.common_words(df) == {"zu", "wo"} and prose.common_words(df.limit(0)) == frozenset()


def test_quality_of_nothing(spark, catalog):
    assert prose.record_quality(spark.createDataFrame([], RECORDS), catalog.limit(0)).count() == 0
    only_null = spark.createDataFrame([(1, None, None, None, None, None, None)], RECORDS)
    assert prose.not_prose(only_null, catalog).count() == 0


def test_sketches_merge(spark, catalog):
    df = spark.createDataFrame([(i, PROSE_EN + " word" * i, "engmix_a-01", None, None, None, None) for i in range(200)], RECORDS)
    stats = prose.measured(df.repartition(7), ["rec_id"]).withColumn("lang", __import__("pyspark").sql.functions.lit("en"))
    q = {r["lang"]: r for r in prose.quantiles(prose.sketches(stats)).collect()}
    base = len(words(PROSE_EN))
    assert abs(q["en"]["n_words"][10] - (base + 100)) <= 6 and q["en"]["n_words"] == q["all"]["n_words"]


@pytest.mark.skipif(not Path(tokens.TOKENIZER_DIR).exists(), reason="no tokenizer files")
@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, catalog, name):
    texts = [PROSE_EN, PROSE_HE, "", None, "x" * 50_000, "<|endoftext|> 🙂\n\t", PROSE_EN]
    df = spark.createDataFrame([(i, t, "engmix_a-01" if i else None, "train", "l", "t", "u") for i, t in enumerate(texts)] + [(0, PROSE_EN, None, "train", "l", "t", "u")], RECORDS)
    got = {r["rec_id"]: r for r in tokens.record_tokens(df, catalog, name).collect()}
    count = tokens.counter(f"{tokens.TOKENIZER_DIR}/{name}")
    assert [got[i]["n_tokens"] for i in range(len(texts))] == [None if t is None else count([t])[0] for t in texts]
    cube = tokens.budget(tokens.record_tokens(df, catalog, name)).collect()
    whole = next(r for r in cube if r["grouping"] == 7)
    assert whole["records"] == len(texts) and whole["n_tokens"] == sum(count([t])[0] for t in texts if t is not None) and whole["token_share"] == 1.0
    assert tokens.budget(tokens.record_tokens(df.limit(0), catalog, name)).where("grouping = 0").count() == 0
    two = [tokens.counter(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.{k}")([PROSE_EN, PROSE_HE]) for k in ("json", "tiktoken")]
    assert two[0] == two[1]


def distance(pattern, text):
    """Least edit distance of pattern to any part of text, by the plain table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for x in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != x), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_against_the_plain_table():
    r = random.Random(1)
    for _ in range(400):
        p = [r.randrange(5) for _ in range(r.randint(1, 64 if r.random() < 0.1 else 12))]
        t = [r.randrange(5) for _ in range(r.randint(0, 30))]
        assert leakage.myers(p, t) == distance(p, t)
    with pytest.raises(ValueError):
        leakage.myers([], [1])


def test_myers_of_many_rows():
    r, rng = random.Random(4), np.random.default_rng(4)
    for m in (3, 10, 64, 70):
        patterns, texts = rng.integers(0, 4, (200, m)).astype(np.uint64), rng.integers(0, 4, (200, m + 4)).astype(np.uint64)
        for i in range(100):  # near ones too
            texts[i, 2 : m + 2] = patterns[i]
            texts[i, r.randrange(m)] = 9
        sizes = rng.integers(0, m + 5, 200)
        got = leakage.myers_all(patterns, texts, sizes)
        assert got.tolist() == [leakage.myers(p.tolist(), t[:k].tolist()) for p, t, k in zip(patterns, texts, sizes)]


def test_many_items_are_one_scan_and_short_ones_are_listed(spark, monkeypatch):
    r = random.Random(6)
    word = lambda: "w%d" % r.randrange(500)
    items = [(k, "t", "test", " ".join(word() for _ in range(r.choice([4, 12, 30]))), None) for k in range(60)] + [(60, "t", "test", None, None)]
    docs = [(k, " ".join(word() for _ in range(20)) + " " + items[k % 60][3] + " " + word()) for k in range(90)]
    docs += [(100, " ".join(items[1][3].split()[:5] * 400))]  # one piece over and over
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, task string, split string, text_a string, text_b string")
    whole = sorted(map(tuple, leakage.leaks(df, it).collect()))
    monkeypatch.setattr(leakage, "MOST_HITS", 3)
    blocks = leakage.leaks(df, it, block_bytes=300)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and sorted(map(tuple, blocks.collect())) == whole
    report = {x["item_id"]: x for x in leakage.item_report(df, it).collect()}
    assert set(report) == set(range(61)) and all(x["too_short"] == (x["words"] < 10) for x in report.values())
    assert all(report[k]["exact_documents"] == (1 + (k < 30) if report[k]["words"] >= 10 else 0) for k in range(60))


def test_leaks_against_brute_force(spark):
    r = random.Random(2)
    vocabulary = ["v%d" % i for i in range(60)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randint(3, 40)), text(r.randint(3, 40)) if i % 3 else None, "t", "test") for i in range(30)]
    items += [(30, items[0][1], None, "t", "test"), (31, None, None, "t", "test"), (32, "", "short text", "t", "test"), (None, text(20), None, "t", "test")]
    docs = []
    for d in range(120):
        t = text(r.randint(5, 60)).split()
        if d % 2:
            source = r.choice(items[:30])[1].split()
            k = r.randint(0, max(0, len(source) - 12))
            part = source[k : k + r.randint(8, 14)]
            if d % 5 == 0 and len(part) > 6:
                part[r.randrange(len(part))] = "edited"
            at = r.randrange(len(t) + 1)
            t[at:at] = part
        docs.append((d, " ".join(t), "item", 1))
    docs += [(500, None, "x", 0), (501, "", "x", 0), (502, items[5][1].upper().replace(" ", ", ") + " z" * 100_000, "x", 0)]
    docs.append(docs[1])
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string, edits int"), spark.createDataFrame(items, "item_id bigint, text_a string, text_b string, task string, split string")
    grams = lambda t, n: {tuple(w[i : i + n]) for w in [words(t)] for i in range(len(w) - n + 1)}
    by_item = {i[0]: grams(i[1], 10) | grams(i[2], 10) for i in items if i[0] is not None}
    expected = {(d[0], i) for d in docs for i, g in by_item.items() if grams(d[1], 10) & g}
    assert {tuple(x) for x in leakage.found(df, it).collect()} == expected
    got = {(x["doc_id"], x["item_id"]): x["edits"] for x in leakage.leaks(df.dropDuplicates(["doc_id"]), it).collect()}
    near = {}
    for d in docs:
        w = words(d[1])
        if len(w) > 1000:
            continue
        for i, g in by_item.items():
            best = min((distance(p, w) for p in g), default=9)
            if best <= 1:
                near[d[0], i] = best
    assert {k: v for k, v in got.items() if k[0] != 502} == near
    # The items may be indexed in several blocks.
    assert {tuple(x) for x in leakage.leaks(df, it, block_bytes=500).where("edits = 0").select("doc_id", "item_id").distinct().collect()} == expected
    assert leakage.found(df.limit(0), it).count() == 0 and leakage.found(df, it.limit(0)).count() == 0


LONG = "Administrative organizations frequently demonstrate considerable bureaucratic responsibilities while participating institutions systematically investigate the comprehensive characteristics of international communication, although individual representatives occasionally misunderstand the fundamental significance of interdisciplinary collaboration. "


def test_levels_and_demanding(spark):
    r = random.Random(4)
    easy, hard = ["cat", "dog", "sun", "red", "run", "big", "hat"], ["hypothesis", "jurisprudence", "electromagnetism", "commodification", "spectroscopy"]

    def doc(share):
        return " ".join(f"the {r.choice(hard if r.random() < share else easy)} of the {r.choice(hard if r.random() < share else easy)} saw a {r.choice(easy)}." for _ in range(12))

    docs, labels = [], []
    for i in range(160):
        level = i % 4 + 1
        docs.append((i, doc((level - 1) / 3), "en", "s", "d", 9.9, "p"))
        if i < 120:
            labels += [(i, k, max(1, min(4, level + r.choice([-1, 0, 0, 0, 1])))) for k in range(2)]
    docs += [(900, LONG * 3, "en", "S ", None, 1.0, ""), (901, LONG.replace("Administrative", "Short. It is so. Administrative") * 3, "en", "s", None, 1.0, ""), (902, None, None, None, None, None, None), (903, "  ", None, None, None, None, None)]
    docs += [(904, "\n".join("* characteristics responsibilities" for _ in range(40)), "en", "s", None, 1.0, ""), (905, "def administrative_function(characteristics): return {responsibilities: [characteristics]}\n" * 9, "en", "s", None, 1.0, ""), (None, LONG, "en", "s", "d", 1.0, "")]
    labels += [(900, 1, None), (None, 1, 3)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, domain string, level double, is_prose string")
    lab = spark.createDataFrame(labels, "doc_id bigint, rater int, level_rated int")
    levelled = reading.levels(df, lab).cache()
    got = {x["doc_id"]: x for x in levelled.collect()}
    held_out = [(got[i]["level"], i % 4 + 1) for i in range(120, 160)]
    assert sum(abs(a - b) for a, b in held_out) / len(held_out) < 0.6
    assert [x["doc_id"] for x in reading.demanding(levelled).collect()] == [900]
    assert not {902, 903, None} & set(got)
    whole = [x for x in reading.profile(levelled).collect() if x["grouping"] == 7]
    assert whole[0]["documents"] == len(got)
    assert all(x["level"] is None for x in reading.levels(df, lab.limit(0)).collect())
    assert reading.levels(df.limit(0), lab).count() == 0
    figures = {x["lang"]: x for x in reading.accuracy(df, lab).collect()}
    assert figures["*"]["documents"] == 120 and figures["*"]["mean_error"] < 0.6 < figures["*"]["mean_error_of_mean"] and figures["*"]["rank_correlation"] > 0.6  # the ratings err by a level in two of five
    assert reading.accuracy(df, lab.limit(0)).count() == 0


def test_words_rule():
    assert words("Café_x ﬁne é שָׁלוֹם a‍b 12.5%") == ["cafe", "x", "fine", "e", "שלום", "ab", "12", "5"]
    assert words(None) == [] and words("") == []
