"""The tagger against a plain decoder, the readers against plain loops, and stated sentences."""

import itertools
import random

import pytest

from doculith.operators import linguistics as L


def _plain(words):
    """The best tags by trying all of them."""
    best = None
    for tags in itertools.product(range(len(L.TAGS)), repeat=len(words)):
        score = L.START[tags[0]] + L.emissions(words[0], True)[tags[0]]
        for j in range(1, len(words)):
            score += L.MOVE[tags[j - 1]][tags[j]] + L.emissions(words[j], False)[tags[j]]
        if best is None or (score, [-t for t in reversed(tags)]) > best[0]:
            best = ((score, [-t for t in reversed(tags)]), tags)
    return "".join(L.TAGS[t] for t in best[1])


def _viterbi(words):
    """The same by plain dynamic programming, for longer sentences."""
    rows = [[(int(L.START[t] + L.emissions(words[0], True)[t]), None) for t in range(len(L.TAGS))]]
    for w in words[1:]:
        e = L.emissions(w, False)
        rows.append([max(((rows[-1][a][0] + int(L.MOVE[a][t]) + int(e[t]), -a) for a in range(len(L.TAGS)))) for t in range(len(L.TAGS))])
    tag = max(range(len(L.TAGS)), key=lambda t: (rows[-1][t][0], -t))
    out = [tag]
    for row in rows[:0:-1]:
        tag = -row[tag][1]
        out.append(tag)
    return "".join(L.TAGS[t] for t in reversed(out))


_VOCABULARY = "the a of to install Open runs quickly valid configuration Paris 42 $5 . , and it is be useful nation Inc zzz walking e-mail".split()


def test_decoder_finds_the_best_tags():
    rng = random.Random(1)
    short = [[rng.choice(_VOCABULARY) for _ in range(rng.randrange(1, 4))] for _ in range(12)]
    assert L.decoded(short) == [_plain(s) for s in short]
    long = [[rng.choice(_VOCABULARY) for _ in range(rng.randrange(1, 60))] for _ in range(600)] + [["a"]]
    assert L.decoded(long) == [_viterbi(s) for s in long]
    assert L.decoded([]) == []


@pytest.mark.parametrize("seed", range(3))
def test_relations_against_loops(seed):
    rng = random.Random(seed)
    for _ in range(400):
        tags = "".join(rng.choice(L.TAGS) for _ in range(rng.randrange(1, 25)))
        phrases, i = [], 0
        while i < len(tags):  # the longest phrase from each free place
            j = i + (tags[i] == "D")
            while j < len(tags) and tags[j] in "JMR":
                j += 1
            k = j
            while k < len(tags) and tags[k] in "NP":
                k += 1
            if k > j:
                phrases.append((i, k))
                i = k
            else:
                i += 1
        verb = lambda p: next((tags[q] for q in range(p, len(tags)) if tags[q] != "R"), "") in ("X", "V")
        subjects = sum(verb(end) for _, end in phrases) + sum(t == "O" and verb(p + 1) for p, t in enumerate(tags))
        starts = lambda p: any(True for _ in [0] if p < len(tags) and (tags[p] == "O" or _phrase_at(tags, p)))
        objects = sum(t == "V" and (starts(p + 1) or tags[p + 1 : p + 2] == "R" and starts(p + 2)) for p, t in enumerate(tags))
        compound = sum(a in "NP" and b in "NP" for a, b in zip(tags, tags[1:], strict=False))
        assert L.relations(tags) == (subjects, objects, tags.count("I"), compound)


def _phrase_at(tags, p):
    p += tags[p] == "D"
    while p < len(tags) and tags[p] in "JMR":
        p += 1
    return p < len(tags) and tags[p] in "NP"


def test_features_of_stated_sentences(spark):
    rows = [
        ("Install the new configuration tool. Dr. Miller of Acme Inc paid $5 in May 2021, or 20% at 10:30 for 7 parts.",),
        ("The useful validation of a large document is never wrong!\nShe opens it",),
        ("",),
        ("?? -- \n .",),
        (None,),
        ("word " * 20_000,),
    ]
    got = L.extract(spark.createDataFrame(rows, "content string").repartition(1)).collect()
    got = {r["content"]: r for r in got}
    first = got[rows[0][0]]
    assert (first["adj_count"], first["dependency_patterns"]["dobj"] >= 1, first["dependency_patterns"]["compound"] >= 1) == (1, True, True)
    assert [e for e in first["entity_types"] if e != "NAME"] == ["PERSON", "ORG", "MONEY", "DATE", "DATE", "PERCENT", "TIME", "CARDINAL"] and first["entity_counts"]["DATE"] == 2
    second = got[rows[1][0]]
    assert (second["noun_count_tagged"], second["adj_count"]) == (2, 3) and second["dependency_patterns"]["nsubj"] >= 2 and second["entity_types"] == []
    for text in ("", rows[3][0]):
        assert (got[text]["verb_count_tagged"], got[text]["entity_types"], tuple(got[text]["dependency_patterns"])) == (0, [], (0, 0, 0, 0))
    assert got[None]["adj_count"] is None and got[None]["dependency_patterns"] is None and got[None]["entity_counts"] is None
    assert got[rows[5][0]]["noun_count_tagged"] + got[rows[5][0]]["verb_count_tagged"] + got[rows[5][0]]["adj_count"] == 20_000
