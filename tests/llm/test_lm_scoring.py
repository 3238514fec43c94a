import math
import random
from collections import Counter

from quillon.llm import lm_scoring
from quillon.llm.common import words

from .helpers import clashing, docs, empty


def brute(texts, order):
    docs_ = [words(t) for t in texts]
    grams = [[Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for k in range(1, order + 1)] for w in docs_]
    total = [sum((g[k] for g in grams), Counter()) for k in range(order)]
    n = sum(map(len, docs_))
    out = []
    for w, own in zip(docs_, grams):
        rest = [total[k] - own[k] for k in range(order)]
        score, backed, unseen = 0.0, 0, 0
        for i in range(len(w)):
            steps = 0
            for k in range(min(order, i + 1), 1, -1):
                gram = tuple(w[i - k + 1 : i + 1])
                if rest[k - 1][gram]:
                    score += math.log(rest[k - 1][gram] / rest[k - 2][gram[:-1]])
                    break
                steps += 1
            else:
                c = rest[0][(w[i],)]
                score += math.log((c or lm_scoring.UNSEEN) / max(1, n - len(w)))
            score += steps * math.log(lm_scoring.BACKOFF)
            backed += steps > 0
            unseen += rest[0][(w[i],)] == 0
        out.append((len(w), backed, unseen, round(score, 6), round(score / len(w), 6) if w else 0.0))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "one", "One ONE one", "zzz"] + [" ".join(rng.choice(["a", "b", "c", "d", "É", "e" * 300]) for _ in range(rng.randrange(1, 60))) for _ in range(30)] + ["same text here"] * 5 + ["w " * 20_000]
    for order in (1, 2, 3):
        got = [tuple(r)[1:4] + (round(r.log_score, 6), round(r.mean_log_score, 6)) for r in sorted(lm_scoring.score(docs(spark, *texts), order).collect(), key=lambda r: r.doc_id)]
        assert got == brute(texts, order)


def test_odd_tables(spark):
    assert lm_scoring.score(empty(spark)).count() == 0
    clash = clashing(docs(spark, "a b", None).unionByName(docs(spark, "a b")), "batch", "fragment", "n_words")
    assert sorted(r.n_words for r in lm_scoring.score(clash).collect()) == [0, 2, 2]
    assert lm_scoring.score(spark.createDataFrame([(None, "x y")], "doc_id long, text string")).first().doc_id is None
