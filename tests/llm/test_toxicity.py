"""Matches of the lexicon where a word beginning and a whole word are of one spelling."""

import math
import random
import time

import pytest

from tessella.llm import toxicity


@pytest.mark.parametrize("weights", [{"trash": 3.0, "trash ": 4.0}, {"trash ": 4.0, "trash": 3.0}])
def test_beginning_and_whole_word_of_one_spelling(weights):
    machine = toxicity.Lexicon(weights).automaton()
    total = lambda text: math.expm1(toxicity.measures(machine, text)[0])
    assert total("trashy talk") == pytest.approx(3)
    assert total("such trash") == pytest.approx(4)
    assert total("trash and trashier") == pytest.approx(7)
    assert total("the trash can is full") == pytest.approx(0)


def test_both_are_chosen_and_inflected_words_match():
    weight = toxicity.chosen({"trash": 20, "trash ": 20, "trashy": 4}, {"trash": 10, "trashy": 1}, 40, 1000, 3.0)
    assert set(weight) == {"trash", "trash "}
    assert toxicity.measures(toxicity.Lexicon(weight).automaton(), "trashy")[2] > 0


def plain_measures(lexicon, text):
    """The same matches and exceptions, each looked for by itself."""
    t = toxicity.folded(text) + " "
    inside = lambda k: t[k : k + 1].isalnum() or t[k : k + 1] == "_"
    best = {}
    for term, weight in lexicon.weights.items():
        stem = term.rstrip(" ")
        for at in range(len(t)):
            if t.startswith(stem, at) and not (at and inside(at - 1)) and not (term.endswith(" ") and inside(at + len(stem))):
                best[at] = max(best.get(at, 0.0), weight)
    for phrase in lexicon.exceptions:
        spelling = toxicity.folded(phrase)
        for at in range(len(t)):
            if t.startswith(spelling, at) and not (at and inside(at - 1)) and not inside(at + len(spelling)):
                best = {s: w for s, w in best.items() if not at <= s < at + len(spelling)}
    total, words = sum(best.values()), 1 + t.count(" ")
    return math.log1p(total), math.log1p(100 * total / (words + 20)), math.log1p(len(best))


def test_exceptions_against_a_plain_search():
    rng = random.Random(6)
    lexicon = toxicity.Lexicon({"trash ": 2.0, "tras": 1.0, "can ": 1.5, "idiot": 3.0, "a": 0.5}, exceptions=("trash can", "can a trash", "an idiot savant"))
    machine = lexicon.automaton()
    for _ in range(300):
        text = " ".join(rng.choice(["trash", "can", "a", "idiot", "an", "savant", "idiots", "trasher", "x", "can.", "xtrash"]) for _ in range(rng.randrange(0, 14)))
        assert toxicity.measures(machine, text) == pytest.approx(plain_measures(lexicon, text))


@pytest.mark.parametrize("piece", ["trash can ", "idiot ", "x", "trash can\n", "\U0001f600 "])
def test_two_megabytes_of_one_phrase(piece):
    machine = toxicity.Lexicon({"trash ": 2.0, "idiot": 1.0}, exceptions=("trash can",)).automaton()
    began = time.perf_counter()
    toxicity.measures(machine, piece * (2_000_000 // len(piece)))
    assert time.perf_counter() - began < 20


def test_exceptions_are_learned_from_clean_rows(spark):
    rng = random.Random(2)
    filler = lambda: " ".join(rng.choice(["river", "stone", "cloud", "green", "window", "paper"]) for _ in range(12))
    texts = [(f"{filler()} you trash person {filler()}", 1) for _ in range(60)] + [(filler(), 0) for _ in range(400)]
    texts += [(f"{filler()} the Tr4sh compactor. {filler()}", 0) for _ in range(9)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    lexicon = toxicity.train(docs, labels)
    assert "trash compactor" in lexicon.exceptions and "trash person" not in lexicon.exceptions
    machine = lexicon.automaton()
    assert toxicity.measures(machine, "a trash compactor, a trash-compactor")[2] == pytest.approx(math.log1p(1))
    got = {r.doc_id: r.predicted for r in toxicity.classify(docs, labels).collect()}
    assert all(got[i] == y for i, (_, y) in enumerate(texts))
