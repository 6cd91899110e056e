"""The backoff automaton against one walked word by word in plain Python; a text that training holds stands out."""
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from navlens.llm import lm


def walk(texts, trained, mu, mu_pair, add=lm.ADD):
    """Scores by explicit states: longest seen history first, failure arcs down to the root."""
    split = [(t or "").lower().split() + ["</s>"] for t in texts]
    arcs, history = Counter(), Counter()
    for words, use in zip(split, trained):
        for i, w in enumerate(words if use else []):
            before = tuple((["<s>"] + words)[max(0, i - 1):i + 1])
            for k in range(len(before) + 1):
                arcs[before[len(before) - k:] + (w,)] += 1
                history[before[len(before) - k:]] += 1
    total, kinds = history[()], sum(len(a) == 1 for a in arcs)

    def probability(state, w):
        if not state:
            return (arcs[(w,)] + add) / (total + add * (kinds + 1))
        strength = mu if len(state) == 1 else mu_pair
        down = strength / (history[state] + strength) * probability(state[1:], w)  # the failure arc
        return down + arcs[state + (w,)] / (history[state] + strength)

    out = []
    for words in split:
        state, score = ("<s>",), 0.0
        for w in words:
            while state and not history[state]:
                state = state[1:]
            score += math.log10(probability(state, w))
            state = (state + (w,))[-2:] if state else (w,)
            if len(state) == 2 and not history[state]:
                state = state[1:]
        out.append(score)
    return out


@pytest.mark.parametrize("mu, mu_pair", [(lm.MU, lm.MU_PAIR), (0.5, 40.0)])
def test_scores_are_those_of_a_walk(spark, make_docs, mu, mu_pair):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(0, 30))) for _ in range(80)]
    texts += [None, "", "never seen words", "a", "a b", "A B a b a b", texts[3], texts[3]]
    trains = F.col("doc_id") % 3 != 0
    got = {r.doc_id: r.score for r in lm.score_texts(make_docs(texts), trains, mu, mu_pair).collect()}
    want = walk(texts, [i % 3 != 0 for i in range(len(texts))], mu, mu_pair)
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=2e-6)


def test_counts_of_many_blocks_are_summed(spark, make_docs, monkeypatch):
    texts = [f"w{i % 7} w{i % 5} w{i % 3} w{i % 7}" for i in range(90)]
    trains = F.col("doc_id") % 2 == 0
    whole = sorted(lm.score_texts(make_docs(texts), trains).collect())
    monkeypatch.setattr(lm, "BLOCK_BITS", 2)
    assert sorted(lm.score_texts(make_docs(texts), trains).collect()) == whole


def test_key_ranges_summed_in_slices(monkeypatch):
    rnd = np.random.default_rng(3)
    packs = [np.unique(rnd.integers(0, 900, rnd.integers(1, 300)).astype(np.uint64)) for _ in range(12)]
    own = [rnd.integers(0, 4, len(k)) for k in packs]
    pdf = pd.DataFrame({"block": range(12), "part": 0, "keys": [lm._pack_keys(k) for k in packs],
                        "counts": [lm._pack_counts(c) for c in own]})
    want = Counter()
    for k, c in zip(packs, own):
        want.update(dict(zip(k.tolist(), c.tolist())))
    for size in (10, 100, 10_000):
        monkeypatch.setattr(lm, "SLICE_KEYS", size)
        out = lm._sum_range(pdf)
        for k, c in zip(packs, out["counts"]):
            assert lm._unpack_counts(c).tolist() == [want[x] for x in k.tolist()]
        words = [c for k, c in want.items() if k % 4 == 0]
        assert out[["n", "v"]].iloc[-1].to_list() == [sum(words), sum(c > 0 for c in words)]


def test_a_held_out_copy_scores_above_its_shuffled_words(spark, make_docs):
    rnd = random.Random(2)
    texts = [" ".join(f"w{rnd.randrange(400)}" for _ in range(60)) for _ in range(60)]
    shuffled = texts[1].split()
    rnd.shuffle(shuffled)
    docs = make_docs(texts + [texts[1], " ".join(shuffled)])
    got = {r.doc_id: r.score for r in lm.score_texts(docs, F.col("doc_id") < 60).collect()}
    assert got[60] > got[61] + 30
