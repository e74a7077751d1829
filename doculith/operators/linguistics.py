"""Parts of speech by sequence decoding, and what a finite-state reader finds in them: kinds of words, entities, relations.

The model is small and stated in full below: scores of listed words and of endings, and of a tag behind another. The
best tags of a sentence are those of the highest sum, found by Viterbi's method for all sentences of an Arrow batch at
once. It is English, untrained and no match for a trained tagger; the definitions are what is tested.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doculith.functions.text import ACTION_FORMS, BE_FORMS, let

#: Noun, name, verb, auxiliary, adjective, adverb, determiner, preposition, pronoun, conjunction, number, `to`, other.
TAGS = "NPVXJRDIOCMTS"
_AT = {t: i for i, t in enumerate(TAGS)}
#: The score of a tag that nothing speaks for.
UNLIKELY = -9

_WORDS = {
    "D": "a an the this that these those each every some any no all both",
    "I": "of in on at by for with from into onto over under about after before between through during without within against",
    "O": "i you he she it we they me him her us them who which what there here",
    "C": "and or but nor so if when while because although than",
    "X": "can could may might must shall should will would have has had do does did " + " ".join(BE_FORMS),
    "R": "not very then also only often always never now just too",
    "T": "to",
    "J": "new good large small big old long short high low own other same different many few first last next valid empty full right wrong",
    "M": "one two three four five six seven eight nine ten hundred thousand million",
}
LEXICON: dict[str, dict[str, int]] = {}
for _tag, _list in _WORDS.items():
    for _word in _list.split():
        LEXICON.setdefault(_word, {})[_tag] = 6
for _word in ACTION_FORMS:
    LEXICON.setdefault(_word, {}).update({"V": 5, "N": 2, **({"J": 1} if _word.endswith("ed") else {})})
#: Endings of words that are not listed; the first that fits counts.
ENDINGS = [
    ("ization", {"N": 5}), ("tion", {"N": 5}), ("sion", {"N": 5}), ("ment", {"N": 5}), ("ness", {"N": 5}), ("ship", {"N": 4}), ("ance", {"N": 4}), ("ence", {"N": 4}), ("ity", {"N": 5}), ("ism", {"N": 5}),
    ("able", {"J": 5}), ("ible", {"J": 5}), ("less", {"J": 5}), ("ful", {"J": 5}), ("ous", {"J": 5}), ("ive", {"J": 4, "N": 1}), ("ical", {"J": 5}), ("al", {"J": 3, "N": 2}), ("ic", {"J": 3, "N": 2}), ("ish", {"J": 3, "V": 1}),
    ("ly", {"R": 5, "J": 1}), ("ize", {"V": 5}), ("ise", {"V": 3, "N": 2}), ("ify", {"V": 5}), ("ing", {"V": 3, "N": 2}), ("ed", {"V": 3, "J": 2}), ("er", {"N": 3, "J": 1}), ("or", {"N": 3}), ("s", {"N": 3, "V": 1}),
]
#: What a word is that is neither listed nor has one of the endings.
OTHER = {"N": 3, "V": 1, "J": 1}
#: Scores of a tag behind another, `^` for the start of a sentence; 0 for what is not named.
FOLLOWS = {
    "^": {"V": 2, "D": 1, "O": 1, "X": -1},
    "D": {"N": 3, "P": 2, "J": 3, "M": 2, "V": -5, "X": -5, "D": -4, "I": -4},
    "J": {"N": 3, "J": 1, "V": -3},
    "M": {"N": 3},
    "N": {"V": 1, "X": 2, "I": 1, "N": 1, "D": -1},
    "P": {"P": 3, "V": 1, "X": 2},
    "O": {"V": 3, "X": 3, "N": -3},
    "X": {"V": 3, "R": 1, "J": 2, "D": 1, "N": -1},
    "R": {"V": 2, "J": 2, "R": 1},
    "T": {"V": 4, "D": 1, "N": 0},
    "V": {"D": 2, "N": 1, "I": 1, "R": 1, "V": -3, "O": 1},
    "I": {"D": 2, "N": 2, "P": 2, "J": 1, "V": -3, "I": -3},
    "C": {"V": 1},
}
START = np.array([FOLLOWS["^"].get(t, 0) for t in TAGS], np.int32)
MOVE = np.array([[FOLLOWS.get(a, {}).get(b, 0) for b in TAGS] for a in TAGS], np.int32)

TOKEN = re.compile(r"[$€£]?\d+(?:[.,:/-]\d+)*%?|[^\W\d_](?:[\w'-]*\w)?|[^\w\s]|_")
#: Sentences end at these tokens and at ends of lines.
STOPS = ".!?"

# Entities: names by what stands in or before them, the rest by the form of a number or of a month.
_MONTHS = "january february march april may june july august september october november december".split()
_FIRMS = {"inc", "corp", "ltd", "gmbh", "llc", "company", "university", "institute", "group"}
_TITLES = {"mr", "mrs", "ms", "dr", "prof"}
RESULT = "struct<verbs:int,nouns:int,adjectives:int,adverbs:int,entity_types:array<string>,nsubj:int,dobj:int,prep:int,compound:int>"
#: Tokens, with padding, that are decoded at once; or one sentence.
DECODED = 50_000
#: A noun phrase over tags, and the relations that a finite-state reader sees.
_PHRASE = "D?[JMR]*[NP]+"
_SUBJECT, _OBJECT, _COMPOUND = re.compile(f"(?:{_PHRASE}|O)(?=R*[XV])"), re.compile(f"V(?=R?(?:{_PHRASE}|O))"), re.compile("[NP](?=[NP])")


def emissions(word: str, first: bool) -> np.ndarray:
    """The score of each tag for a token; a capitalised word inside of a sentence is a name."""
    scores = np.full(len(TAGS), UNLIKELY, np.int32)
    if not (word[0].isalpha() or word[0].isdigit() or len(word) > 1):
        scores[_AT["S"]] = 9
        return scores
    if word[0].isdigit() or not word[0].isalpha():
        scores[_AT["M"]] = 9
        return scores
    low = word.lower()
    known = LEXICON.get(low)
    if known is None:
        known = next((s for end, s in ENDINGS if low.endswith(end) and len(low) > len(end) + 1), OTHER)
    for tag, score in known.items():
        scores[_AT[tag]] = score
    if word[0].isupper() and not first and (low not in LEXICON or low in _MONTHS):
        scores[_AT["P"]] = 8
    return scores


def sentences(text: str) -> list[list[str]]:
    """The tokens of each sentence; one with neither a word nor a number is left out."""
    out: list[list[str]] = []
    for line in text.split("\n"):
        own: list[str] = []
        for token in TOKEN.findall(line):
            own.append(token)
            if token in STOPS and not (token == "." and len(own) > 1 and own[-2].lower() in _TITLES):
                out.append(own)
                own = []
        out.append(own)
    return [s for s in out if any(t[-1].isalnum() or t[0].isalnum() for t in s)]


def decoded(lists: list[list[str]], cache: dict[tuple[str, bool], np.ndarray] | None = None) -> list[str]:
    """The tags of each sentence with the highest sum of scores, as a string; of equal sums the one whose last tags come first in TAGS."""
    cache = {} if cache is None else cache
    out = [""] * len(lists)
    order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    begin = 0
    while begin < len(order):  # of about equal lengths, and of a bounded size together
        stop = begin + 1
        while stop < len(order) and len(lists[order[stop]]) * (stop + 1 - begin) <= DECODED:
            stop += 1
        rows, begin = order[begin:stop], stop
        most = len(lists[rows[-1]])
        size = np.array([len(lists[i]) for i in rows])
        emit = np.zeros((most, len(rows), len(TAGS)), np.int32)
        for k, i in enumerate(rows):
            for j, word in enumerate(lists[i]):
                key = (word, j == 0)
                if key not in cache:
                    cache[key] = emissions(*key)
                emit[j, k] = cache[key]
        score = START + emit[0] if most else np.zeros((len(rows), len(TAGS)), np.int32)
        back = np.zeros((most, len(rows), len(TAGS)), np.int8)
        final = score.copy()
        for j in range(1, most):
            ways = score[:, :, None] + MOVE
            back[j] = ways.argmax(1)
            score = ways.max(1) + emit[j]
            final[size == j + 1] = score[size == j + 1]
        tag = final.argmax(1)
        paths = np.zeros((most, len(rows)), np.int8)
        for j in range(most - 1, -1, -1):
            inside = size > j
            paths[j, inside] = tag[inside]
            if j:
                tag = np.where(inside, back[j, np.arange(len(rows)), tag], tag)
        for k, i in enumerate(rows):
            out[i] = "".join(TAGS[t] for t in paths[: size[k], k])
    return out


def entity_types(words: list[str], tags: str) -> list[str]:
    """The type of each entity of a sentence, in order: runs of names, and numbers by their form."""
    out, i = [], 0
    while i < len(words):
        low = words[i].lower()
        if tags[i] == "P":
            j = i
            while j < len(words) and tags[j] == "P":
                j += 1
            run = [w.lower() for w in words[i:j]]
            before = next((w.lower() for w in reversed(words[:i]) if w != "."), "")
            out.append("ORG" if _FIRMS & set(run) else "DATE" if run[0] in _MONTHS else "PERSON" if before in _TITLES or run[0] in _TITLES else "NAME")
            i = j
            continue
        if tags[i] == "M":
            after = words[i + 1].lower() if i + 1 < len(words) else ""
            if low[0] in "$€£":
                out.append("MONEY")
            elif low.endswith("%") or after == "percent":
                out.append("PERCENT")
            elif re.fullmatch(r"(19|20)\d\d|\d{4}-\d\d?-\d\d?|\d\d?/\d\d?/\d{2,4}", low):
                out.append("DATE")
            elif re.fullmatch(r"\d\d?:\d\d(:\d\d)?", low):
                out.append("TIME")
            else:
                out.append("CARDINAL")
        i += 1
    return out


def relations(tags: str) -> tuple[int, int, int, int]:
    """(nsubj, dobj, prep, compound) of a sentence's tags: phrases before a verb, verbs before a phrase, prepositions, nouns before a noun."""
    return len(_SUBJECT.findall(tags)), len(_OBJECT.findall(tags)), tags.count("I"), len(_COMPOUND.findall(tags))


def _counted(texts: list[str | None], cache: dict) -> list[dict | None]:
    lists = [[] if t is None else sentences(t) for t in texts]
    flat = iter(decoded([s for own in lists for s in own], cache))
    out: list[dict | None] = []
    for text, own in zip(texts, lists, strict=True):
        tags = [next(flat) for _ in own]
        joined = "".join(tags)
        found = [relations(t) for t in tags]
        row = dict(zip(("verbs", "nouns", "adjectives", "adverbs"), (joined.count(t) for t in "VNJR"), strict=True))
        row["entity_types"] = [e for s, t in zip(own, tags, strict=True) for e in entity_types(s, t)]
        row |= {name: sum(f[i] for f in found) for i, name in enumerate(("nsubj", "dobj", "prep", "compound"))}
        out.append(None if text is None else row)
    return out


#: Texts whose sentences are decoded together.
BATCH = 256


def _analysed(text: Column) -> Column:
    kind = pa.struct([*((n, pa.int32()) for n in ("verbs", "nouns", "adjectives", "adverbs")), ("entity_types", pa.list_(pa.string())), *((n, pa.int32()) for n in ("nsubj", "dobj", "prep", "compound"))])

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict = {}
        for texts in batches:
            parts = [pa.array(_counted(texts.slice(i, BATCH).to_pylist(), cache), kind) for i in range(0, len(texts), BATCH)]
            if len(cache) > 200_000:
                cache.clear()
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run.asNondeterministic()(text)


def extract(chunks: DataFrame, content: str = "content") -> DataFrame:
    """Adds verb_count_tagged, noun_count_tagged, adj_count, entity_types, entity_counts (by type) and dependency_patterns.

    A text without words has counts of 0 and no entities, a null text nulls. Only the text goes through Python.
    """
    out = chunks.withColumn("_said", _analysed(F.col(content)))
    s = F.col("_said")
    by_type = lambda t: F.map_from_entries(F.transform(F.array_sort(F.array_distinct(t)), lambda k: F.struct(k, F.size(F.filter(t, lambda x: x == k)))))
    pattern = F.when(s.isNotNull(), F.struct(s["nsubj"].alias("nsubj"), s["dobj"].alias("dobj"), s["prep"].alias("prep"), s["compound"].alias("compound")))
    return out.withColumns({"verb_count_tagged": s["verbs"], "noun_count_tagged": s["nouns"], "adj_count": s["adjectives"], "entity_types": s["entity_types"], "entity_counts": let(s["entity_types"], by_type), "dependency_patterns": pattern}).drop("_said")
