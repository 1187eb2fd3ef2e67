"""The subsequence kernel against its definition, the machine against labels held out."""

import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from hazelake.llm import toxicity


def brute_kernel(a, b):
    """By listing subsequences."""

    def weights(word):
        letters, out, square = f"^{word}$", {}, 0.0
        for places in combinations(range(len(letters)), toxicity.LETTERS):
            span = places[-1] - places[0] + 1
            if span <= toxicity.SPAN:
                key = "".join(letters[i] for i in places).replace("$", "^")  # both ends are one mark
                out[key] = out.get(key, 0) + toxicity.DECAY ** span
                square += toxicity.DECAY ** (2 * span)
        return out, square ** 0.5 or 1

    (x, p), (y, q) = weights(a), weights(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / p / q


@settings(max_examples=150, deadline=None)
@given(st.text("abx", min_size=2, max_size=12), st.text("abx", min_size=2, max_size=12))
def test_kernel_by_definition(a, b):
    assert toxicity.kernel(a, b) == pytest.approx(brute_kernel(a, b))


def test_gapped_and_spelled_words_are_alike():
    assert toxicity.kernel("idiot", "i.d-i_o.t!") == pytest.approx(toxicity.kernel("idiot", "idiot"))
    assert toxicity.kernel("moron", "m0r0n") == pytest.approx(toxicity.kernel("moron", "moron"))
    assert toxicity.kernel("idiot", "idxiot") > 3 * toxicity.kernel("idiot", "idea")
    assert toxicity.tokens("You I D I O T a") == ["you", "i d i o t a"] and toxicity.tokens("x y") == ["x", "y"]
    assert toxicity.codes("12") == toxicity.codes("...") == [] and len(toxicity.codes("x" * 1000)) > 100


def test_svm_minimises_squared_hinge():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    positive, negative = rng.random(60) * (x[:, 0] > 0), rng.random(60) * (x[:, 0] <= 0.2)
    w = toxicity._svm(x, positive, negative, 0.1)

    def loss(w):
        m = x @ w[:-1] + w[-1]
        return (positive * np.maximum(0, 1 - m) ** 2 + negative * np.maximum(0, 1 + m) ** 2).sum() + 0.1 * w[:-1] @ w[:-1]

    assert all(loss(w) <= loss(w + d) + 1e-9 for d in rng.normal(size=(200, 4)) * 0.01)


INSULTS = "blorgface snivelrat numbskrull dungwit".split()


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents of invented words; toxic ones hold insults, some of them disguised in the held-out part."""
    rng = random.Random(8)
    syllables = "ta re mo lin ka su vel do ish an per qui sto".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(900):
        sentences = [" ".join(word() for _ in range(rng.randint(4, 12))) + "." for _ in range(rng.randint(1, 12))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                insult = rng.choice(INSULTS)
                if zlib.crc32(str(i).encode()) % 5 == 0 and i % 4 == 0:
                    insult = rng.choice([".".join(insult), " ".join(insult), insult[:4] + "x" + insult[4:], insult.upper()])
                sentences.insert(rng.randint(0, len(sentences)), f"{word()} {insult} {word()}.")
        rows.append((i, "\n".join(sentences) if i % 2 else " ".join(sentences), "x", 0.5))
        if i % 3 != 1:
            labels.append((i, int(toxic)))
    rows += [(5000, None, None, None), (5001, "", "x", 0.0), (None, rows[0][1], None, None), (5002, "12 $$ ...", "x", 0.0), rows[6], rows[6]]
    labels += [(None, 1), (7, None), (10**9, 1), labels[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, WORST string, score double").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    machine, share = toxicity.fit(docs, labels)
    rows = toxicity.scored(docs, machine, share).withColumn("held", toxicity.held_out()).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held"] and r["doc_id"] is not None and r["doc_id"] < 900]
    toxic = [r["predicted"] for r in held if r["doc_id"] % 6 == 0]
    clean = [r["predicted"] for r in held if r["doc_id"] % 6]
    assert len(toxic) > 20 and np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.02
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[None]["held"] is True and by_id[None]["score"] == by_id[0]["score"]
    assert by_id[5000]["score"] == by_id[5001]["score"] == by_id[5002]["score"] < 0.5 and by_id[5000]["worst"] is None


def test_same_model_whatever_the_partitions(corpus):
    docs, labels = corpus
    one, two = (toxicity.fit(d, x)[0] for d, x in ((docs, labels), (docs.repartition(7), labels.repartition(3))))
    assert np.allclose(one.weights, two.weights) and one.slope == pytest.approx(two.slope)


@pytest.mark.parametrize("label", [0, 1, None])
def test_labels_of_one_kind_give_their_share(spark, corpus, label):
    docs, labels = corpus
    machine, share = toxicity.fit(docs, labels.withColumn("toxic", F.lit(label).cast("int")))
    assert machine is None and {r["score"] for r in toxicity.scored(docs, machine, share).collect()} == {float(label or 0)}


def test_empty_tables(corpus):
    docs, labels = corpus
    machine, share = toxicity.fit(docs.where("false"), labels)
    assert machine is None and toxicity.scored(docs.where("false"), machine, share).collect() == []
