"""Insults that are taken apart score as the insults do."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.llm.toxicity import _tops, heads_of, train_toxicity, views, words_of
from tests.llm.test_documents import labelled

INSULTS = ["blockhead", "numbskull", "nitwit"]


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = labelled(spark)
    return train_toxicity(docs, labels, F.lit(True))


def margins(model, words):
    return next(_tops(model, iter([pd.Series([f"word1 {w} word2" for w in words])])))[:, 0]


@pytest.mark.parametrize("insult", INSULTS)
def test_a_character_between_all_letters(model, insult):
    apart = [g.join(insult) for g in ("*", ".", "-", "x", "7", "**")] + ["(" + "_".join(insult) + ")!", "q" + "q".join(insult)]
    plain, *found = margins(model, [insult, *apart])
    assert plain > 0.5 and min(found) >= plain - 1e-9
    assert margins(model, ["word3"])[0] == model.bias < plain


@pytest.mark.parametrize("insult", INSULTS)
def test_blanks_between_pieces(model, insult):
    plain, *found = margins(model, [insult, *[insult[:k] + " " + insult[k:] for k in range(2, len(insult) - 1)], f"{insult[:2]} {insult[2:4]} {insult[4:]}"])
    assert min(found) >= plain - 1e-9


def test_the_machine_is_asked_about_every_word(model):
    words = ["word1", "blockxhead", "b.l.o.c.k", "skull", "zz", "numbers"]
    tokens = [v for w in words for v in views(w)]
    whole = model.landmarks.kernel(tokens) @ model.weights + model.bias
    cut = model.margins(tokens)
    assert all(a == pytest.approx(b) or (b <= 0 and a <= max(0, model.bias)) for a, b in zip(cut, whole, strict=True))


def test_views_and_pieces():
    assert {"s*t*u*p*i*d", "stupid"} <= set(views("s*t*u*p*i*d!")) and "stupid" in views("sxtyuzpwivd")
    assert {"stupid", "stupidly"} <= words_of("so stu pid and st up idly", heads_of(["stupid"]))
