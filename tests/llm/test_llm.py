"""The text operators: brute force, exact round trips, held-out accuracy, edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from tickforge.llm import encoding, mixture, pairs, subjects

ALPHABET = "abcdefghij  \n\t'sretvmdl.,!?é你🎉019ABC"


@pytest.fixture(scope="module")
def reference_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(encoding.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=encoding.PIECES.pattern, mergeable_ranks=ranks, special_tokens={})


# -- encoding ---------------------------------------------------------------------------------------------------


def test_encoding_equals_the_library(reference_encoding):
    e, rng = encoding.encoder(), random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["a" * 3000, " " * 2000, "ab" * 2000, "<|endoftext|>", "\u0000﻿", "I'll we've 'tis"]
    assert [t for t in texts if e.encode(t) != reference_encoding.encode_ordinary(t)] == []
    assert all(e.count(t) == len(e.encode(t)) for t in texts)


def test_appends_and_edits_are_exact(reference_encoding):
    rng, enc = random.Random(2), encoding.encoder()
    for _ in range(300):
        t = encoding.EncodedText(enc, "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))))
        for _ in range(4):
            a = rng.randint(0, len(t.text))
            b = rng.randint(a, min(len(t.text), a + 6))
            t.edit(a, b, "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 6))))
            t.append(rng.choice(["", " ", "'", "re", "s x"]))
        assert t.ids == reference_encoding.encode_ordinary(t.text)


def test_prefix_table_holds_every_prefix(reference_encoding):
    data = b"unbelievably"
    table = encoding.PrefixTable(encoding.encoder().vocabulary)
    for i in range(len(data)):
        table.append(data[i : i + 1])
    for n in range(len(data) + 1):
        assert table.tokens(n) == reference_encoding.encode_ordinary(data[:n].decode())
    assert table.truncate(4).append(b"done").tokens() == reference_encoding.encode_ordinary("unbedone")


def test_null_and_empty_texts_have_no_ids(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello"), (3, "hello")], "doc_id BIGINT, text STRING")
    got = sorted((r["doc_id"], list(r["ids"])) for r in encoding.encode_texts(df.withColumn("ids", F.lit("clash"))).collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and got[2][1]
    assert encoding.encode_texts(df.limit(0)).count() == 0
    assert [r["n_tokens"] for r in encoding.count_tokens(df).orderBy("doc_id").collect()] == [0, 0, 1, 1]


# -- mixture ----------------------------------------------------------------------------------------------------


def test_mixture_meets_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, rng.choices(["big", "mid", "small", None, "other"], [60, 25, 5, 5, 5])[0], "word " * rng.randint(1, 40)) for i in range(3000)]
    rows += [(9001, "mid", None), (9002, "mid", "")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, source STRING, text STRING")
    targets = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.3, 3), ("small", 0.2, 4), ("absent", 0.0, 2)], "source STRING, target_share DOUBLE, max_repeats INT")
    mixed, shares = mixture.mix(docs, targets, keep_tokens=True)
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("copy").alias("m")).collect()
    total = sum(r["n"] for r in got)
    caps = {"big": 2, "mid": 3, "small": 4}
    want = {"big": 0.5, "mid": 0.3, "small": 0.2}
    assert {r["source"] for r in got} == set(want)
    assert all(abs(r["n"] / total - want[r["source"]]) < 0.005 and r["m"] <= caps[r["source"]] for r in got)
    reported = {r["source"]: r for r in shares.collect()}
    assert all(reported[r["source"]]["mixed_tokens"] == r["n"] for r in got) and reported["absent"]["actual_share"] == 0
    keys = [r["shuffle_key"] for r in mixed.select("shuffle_key").collect()]
    assert keys == sorted(keys)
    copies = mixed.groupBy("doc_id").agg(F.count("*").alias("c"), F.max("copy").alias("m"), F.countDistinct("copy").alias("d")).where("c <> m OR c <> d")
    assert copies.count() == 0
    assert mixture.mix(docs.limit(0), targets)[0].count() == 0


def test_small_rates_keep_their_size(spark):
    """Targets of a few thousandths and less of a source, far below one step of a coarse histogram."""
    docs = spark.range(60000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, "small").otherwise("huge").alias("source"), F.lit("one two").alias("text"))
    for total, wanted in ((3000, 300), (2100, 30)):
        targets = spark.createDataFrame([("huge", wanted / total, 3), ("small", 1 - wanted / total, 50)], "source STRING, target_share DOUBLE, max_repeats INT")
        mixed, shares = mixture.mix(docs, targets, total_tokens=total)
        got = {r["source"]: r["mixed_tokens"] for r in shares.collect()}
        assert abs(got["huge"] - wanted) <= 2 and abs(got["small"] - (total - wanted)) <= 2
        assert mixed.where("source = 'huge'").count() * 2 == got["huge"]


def test_poisson_inversion():
    import numpy as np

    u = (np.arange(20000) + 0.5) / 20000
    c = mixture.counts_at(u, 1.3, 50)
    assert abs(c.mean() - 1.3) < 0.01 and abs(c.var() - 1.3) < 0.02
    assert mixture.counts_at(u, float("inf"), 3).min() == 3
    assert mixture.solve_rate(u, np.ones(20000), 26000, 50) == pytest.approx(1.3, abs=0.01)


# -- pairs ------------------------------------------------------------------------------------------------------

PAIRS = [
    ("What does Acme plc say about costs?", "Acme plc reports that costs rose by 5% in the year [S1].", None),
    ("What does Acme plc say about costs?", "It expects no change.", None),
    ("What does Acme plc say about costs?", "About 12% [S2]", None),
    ("What does Acme plc say about costs?", "No. [S4]", None),
    ("What does Acme plc say about costs?", "What does Acme plc say about costs? Acme plc warns that prices could delay its plans for the plant.", None),
    ("What does Acme plc say about costs?", "The filings do not quantify costs, but they do say the following. Acme plc set aside $5m for repairs [S1].", None),
    ("What does Acme plc say about costs?", "It is unable to predict when demand will recover, but has cut spending by $5m [S1].", None),
    ("What does Acme plc say about costs?", "Acme plc names several points:\n\n- rising costs of steel [S2]\n- pressure from fuel costs", None),
    ("What does Acme plc say about costs?", "The German-language annex uses the term “Kosten” for this [S1].", None),
    *[("What does Acme plc say about costs?", x, "empty") for x in (None, "", " ​", "[S1] [S2]", "n/a", "null", "...", "—", "Answer:", '""')],
    *[("What does Acme plc say about costs?", x, "truncated") for x in ("Acme plc reports that costs rose and that the", "Acme plc reports that costs rose in the year [S", "Acme plc reports that the costs of steel …", "Costs rose by $5m, and the company expects it to,", "In fiscal 2025, the")],
    *[("What does Acme plc say about costs?", x, "refusal") for x in ("I'm sorry, but I can't answer that from the excerpts supplied.", "The excerpts do not contain enough information. Please rephrase the question.", "Nothing in the passages is about costs, so no answer can be given. [S1]")],
    ("Was sagt Acme über Kosten?", "Anhand der Quellen lässt sich die Frage nicht beantworten.", "refusal"),
    ("¿Qué dice Acme sobre costes?", "Las fuentes no permiten contestar la pregunta.", "refusal"),
    ("Que dit Acme au sujet de coûts ?", "Les sources ne permettent pas de répondre à la question.", "refusal"),
    *[("What does Acme plc say about costs?", x, "copied") for x in ("WHAT DOES ACME PLC SAY ABOUT COSTS?", "what does acme plc say about costs", "What does Acme plc say costs? [S1]", "Question: What does Acme plc say about costs?")],
    ("What does Acme plc say about costs?", "Laut Bericht wurden die Kosten im Jahr nicht gesenkt, und das Ende ist offen [S1].", "language"),
    ("Was sagt Acme über die Kosten im Jahr 2020?", "The company says that the costs of steel were only partly passed on to buyers.", "language"),
    ("What does Acme plc say about costs?", "La società riferisce che i costi sono aumentati nel periodo e che la spesa è salita.", "language"),
]


def test_pair_defects(spark):
    rows = [(i, q, a) for i, (q, a, _) in enumerate(PAIRS)]
    rows += [(1000 + i, "What does Acme plc say about costs?", f"Acme plc reports that costs rose by {i}% in the year, and it expects the same for the next [S1].") for i in range(200)]
    df = spark.createDataFrame(rows, "answer_id BIGINT, question STRING, answer STRING")
    got = {r["answer_id"]: r["defect"] for r in pairs.one_defect(df).collect()}
    assert [(PAIRS[i][1], got.get(i), d) for i, (_, _, d) in enumerate(PAIRS) if got.get(i) != d] == []
    assert not [i for i in got if i >= 1000]
    labels = {r["answer_id"]: r["defects"] for r in pairs.pair_labels(df).collect()}
    assert len(labels) == len(rows)
    assert pairs.one_defect(df.limit(0)).count() == 0
    assert pairs.one_defect(spark.createDataFrame([(1, None, None), (2, None, "It rose. " * 20000)], df.schema)).collect()[0]["answer_id"] == 1


def test_label_model_recovers_a_noisy_truth():
    rng, patterns, truth = random.Random(4), {}, {}
    for _ in range(4000):
        y = rng.random() < 0.1
        p = "".join("0" if rng.random() < 0.2 else ("+" if (y if rng.random() < acc else not y) else "-") for acc in (0.95, 0.9, 0.85))
        patterns[p] = patterns.get(p, 0) + 1
        truth.setdefault(p, []).append(y)
    post = pairs.fit_label_model(patterns)
    wrong = sum(sum(v != (post[p] >= 0.5) for v in ys) for p, ys in truth.items())
    assert wrong / 4000 < 0.06 and post["000"] < 0.5
    assert pairs.fit_label_model({}) == {}


def test_label_model_knows_functions_that_copy_each_other():
    """Three copies of one noisy vote and one good independent one: a product of all four would follow the copies."""
    rng, patterns, truth = random.Random(5), {}, {}
    for _ in range(6000):
        y = rng.random() < 0.2
        noisy, good = (y if rng.random() < acc else not y for acc in (0.85, 0.97))
        p = "".join("+" if v else "-" for v in (noisy, noisy, noisy, good))
        patterns[p] = patterns.get(p, 0) + 1
        truth.setdefault(p, []).append(y)
    errors = {}
    for name, blocks in (("blocks", (3, 1)), ("independent", (1, 1, 1, 1))):
        post = pairs.fit_label_model(patterns, blocks)
        errors[name] = sum(sum(v != (post[p] >= 0.5) for v in ys) for p, ys in truth.items())
    model = pairs.LabelModel((3, 1)).fit(patterns)
    assert model.rho[0] > 0.9 and errors["blocks"] <= errors["independent"]


def test_more_than_a_third_may_be_defective():
    model = pairs.LabelModel((2, 1)).fit({"+++": 540, "---": 300, "++-": 60, "--+": 60, "+-+": 40})
    assert model.prior > 0.5 and model.posterior("+++") > 0.9 and model.posterior("---") < 0.1


def test_cutoffs_and_planted_defects():
    assert pairs.best_cutoff([0.1, 0.2], [0.8, 0.9]) == 0.5 and 0.2 < pairs.best_cutoff([0.1, 0.2], [0.3, 0.9]) <= 0.3 and pairs.best_cutoff([], []) == 0.5
    sample = [("What did Acme say about peak load?", "Acme reports that peak load rose by 5% in the year. It expects no further change."), ("Was sagt Acme über Strom?", "Das Unternehmen sagt, dass die Kosten für Strom im Jahr um 5 % stiegen.")] * 8
    planted = pairs._plant(sample, ["I cannot answer that."])
    assert all(planted[d] for d in pairs.PRECEDENCE)
    votes = pairs.votes_of("What does Acme say about peak load in the winter?", "Spółka ostrzega, że wyniki mogą być słabsze niż oczekiwano w tym roku")
    assert "+" in votes["language"]  # a language that no list has
    assert pairs.votes_of("What does Acme say?", "Компания сообщает, что расходы выросли")["language"][4] == "+"


def test_the_flag_is_one_vote(spark):
    rows = [(k, "What did Acme say about peak load?", f"Acme reports that peak load rose by {k}% in the year.", k % 5 == 0) for k in range(1, 60)]
    rows += [(100 + k, "What did Acme say about peak load?", "I cannot answer this question.", None) for k in range(9)]
    df = spark.createDataFrame(rows, "answer_id BIGINT, question STRING, answer STRING, refused BOOLEAN")
    assert {r["answer_id"]: r["defect"] for r in pairs.one_defect(df).collect()} == {100 + k: "refusal" for k in range(9)}
    assert pairs.rules_compared(df).where("defect = 'refusal'").first()["by_any"] > 9


# -- subjects ---------------------------------------------------------------------------------------------------

TOPICS = {
    "energy": ["wind turbines", "gas pipeline", "fuel oil", "solar arrays", "peak load"],
    "law": ["class action", "jury verdict", "court filings", "appeals court", "consent decree"],
    "sport": ["season tickets", "match days", "league rights", "stadium seats", "golf courses"],
}
TEMPLATES = ["Spending on {a} rose sharply in the year.", "Both {a} and {b} depend on third parties.", "No single counterparty for {a} exceeded 5% of the total.", "Changes in {a} and {b} had the largest effect."]
PLAIN = ["The board met 5 times in 2020.", "Amounts are rounded and may not add up.", "We paid no dividend in 2019."]


def corpus(n, seed):
    rng, docs, truth = random.Random(seed), [], []
    for i in range(n):
        main = rng.sample(sorted(TOPICS), rng.choice([0, 1, 1, 2]))
        said = []
        for t in sorted(TOPICS):
            k = rng.randint(3, 6) if t in main else rng.choice([0, 0, 1, 2])
            for _ in range(k):
                a, b = rng.sample(TOPICS[t], 2)
                said.append(rng.choice(TEMPLATES).format(a=a, b=b))
        said += rng.choices(PLAIN, k=4)
        rng.shuffle(said)
        docs.append((i, "\n\n".join(" ".join(said[j : j + 3]) for j in range(0, len(said), 3)), "Acme Labs"))
        truth += [(i, t) for t in main]
    return docs, truth


def test_subjects_of_held_out_documents(spark):
    docs, truth = corpus(400, 5)
    docs += [(900, None, None), (901, "", None), (902, "|--|--|", "x")]
    seeds = [t for t in truth if t[0] % 8 == 0] + [(5000, "law")]
    d = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, company STRING")
    areas = spark.createDataFrame([(t, "") for t in TOPICS], "subject STRING, about STRING")
    s = spark.createDataFrame(seeds, "doc_id BIGINT, subject STRING")
    got = {tuple(r) for r in subjects.propagate(d, areas, s).collect()}
    want = set(truth) | {(5000, "law")}
    assert len(got & want) / len(want) > 0.95 and len(got - want) / len(want) < 0.05
    assert set(map(tuple, seeds)) <= got
    assert subjects.propagate(d.limit(0), areas, s.limit(0)).count() == 0


def test_sentences():
    text = "Item 1A. Risk Factors\n\nSpending on cloud work-\nloads rose to USD 5 thousand. Für 3 Mio. € wurden Bauwérke gekauft! Acme​ Inc. was formed in 2019."
    assert subjects.sentence_words(text, "Acme Inc.") == ["item a", "risk factors", "spending on cloud workloads rose to usd thousand", "fur mio wurden bauwerke gekauft", "was formed in"]
    assert subjects.sentence_words(None) == [] and subjects.sentence_words("") == []
