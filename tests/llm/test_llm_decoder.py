"""The decoder against a search over all readings; tokens that an earlier version left out."""
import itertools
import random

import numpy as np
import pytest

from navlens.llm import toxicity as X

rnd = random.Random(8)


@pytest.fixture(scope="module")
def channel():
    counts = np.zeros(X.LETTERS ** X.ORDER, np.int64)
    words = {"idiot": 60, "you": 90, "are": 90, "an": 80, "vile": 30, "scum": 30, "hello": 50, "world": 50, "tab": 9, "cat": 9}
    X.count_ngrams(words, counts)
    return X.Channel(counts)


def best_score(channel, token):
    """Score of the best reading among all."""
    best = -np.inf
    for path in itertools.product(*channel._choices(token)):
        state, total = 0, 0.0
        for emitted, cost in path:
            total += cost
            if emitted == " ":
                total, state = total + channel.logp[state * X.LETTERS], 0
            elif emitted:
                code = ord(emitted) - 96
                total += channel.logp[state * X.LETTERS + code]
                state = (state * X.LETTERS + code) % X.LETTERS ** 3
        best = max(best, total + channel.logp[state * X.LETTERS])
    return best


def scored(channel, token, reading):
    """Best score of a path that gives this reading."""
    paths = {(0, 0): 0.0}  # (letters of the reading given, state) -> score
    for some in channel._choices(token):
        new = {}
        for (at, state), total in paths.items():
            for emitted, cost in some:
                to, t = (at, state), total + cost
                if emitted:
                    if reading[at:at + 1] != emitted:
                        continue
                    if emitted == " ":
                        to, t = (at + 1, 0), t + channel.logp[state * X.LETTERS]
                    else:
                        code = ord(emitted) - 96
                        to = (at + 1, (state * X.LETTERS + code) % X.LETTERS ** 3)
                        t += channel.logp[state * X.LETTERS + code]
                new[to] = max(new.get(to, -np.inf), t)
        paths = new
    return max(t + channel.logp[state * X.LETTERS] for (at, state), t in paths.items() if at == len(reading))


def test_decoder_equals_exhaustive_search(channel):
    for _ in range(300):
        token = "".join(rnd.choices("ab1di0t@$. -sscu", k=rnd.randint(1, 9)))
        assert scored(channel, token, channel.restore(token)) == pytest.approx(best_score(channel, token), abs=1e-6)


def test_wild_characters_keep_all_states(channel):
    for token in ["s**m", "i***t", "*d*o*", "v*l*#", "***", "a*#*1"]:
        reading = channel._restore_wild(channel._choices(token))
        assert scored(channel, token, reading) == pytest.approx(best_score(channel, token), abs=1e-4)
        assert scored(channel, token, channel.restore(token)) == pytest.approx(best_score(channel, token), abs=1e-4)


def test_both_decodings_agree(channel):
    for _ in range(30):
        token = "".join(rnd.choices("ab1di0t@$.-*sscu", k=rnd.randint(1, 300)))
        plain = channel._choices(token.replace("*", "o"))
        a = channel._restore_wild(plain)
        b = channel.restore(token.replace("*", "o"))
        word = token.replace("*", "o")
        assert scored(channel, word, a) == pytest.approx(scored(channel, word, b), abs=1e-3)


@pytest.mark.parametrize("text", [
    "one,two,three,four,five,six,seven,eight,nine,ten,eleven,twelve,thirteen,fourteen,you,are,an,1d10t",
    "i - d - i - o - t", "i  d  i  o  t", "you are an i.d.i.o.t!", "a/b/c/1d10t/x" * 1, "1d10t" + "," + "x" * 200,
    "idiiiiiiii" + "i" * 120 + "ot"])
def test_tokens_that_must_be_read(channel, text):
    words, _ = X.Restorer(channel).words(text)
    assert "idiot" in words


def test_three_spaced_letters(channel):
    assert "cat" in X.Restorer(channel).words("the c a t sat")[0]


def test_long_tokens_are_read_in_bounded_memory(channel):
    assert len(channel.restore("a" + "*" * 400 + "b")) >= 2
    assert X.Restorer(channel).words("x1" * 5000)[1] == 1
