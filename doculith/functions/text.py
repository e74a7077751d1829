"""Column expressions over text: trimming, escaping, identifiers, Markdown structure and lexical features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The verbs that mark an instruction.
ACTION_VERBS = (
    "install download click run execute configure setup create delete update modify copy move open close save load start stop restart "
    "enable disable select choose enter type press set add remove edit change verify check"
).split()
BE_FORMS = ["am", "is", "are", "was", "were", "be", "been", "being"]
STOP_WORDS = "a an the and or but if of in on at to for from by with as it its this that these those he she they we you i not no so then than there here who which what when where how".split()
# The patterns that make a text a definition, matched in lower-cased text.
DEFINITIONS = [
    r"\b\w+ is (a|an|the)?\s*\w+",
    r"\b\w+ are \w+",
    r"\b\w+ means \w+",
    r"\b\w+ refers to \w+",
    r"\b\w+ can be defined as",
    r"\b\w+ represents \w+",
]
# Title words that speak for a type.
TITLE_WORDS = {
    "Task": ["install", "configure", "setup", "create", "how to", "guide", "step", "tutorial", "walkthrough", "procedure"],
    "Reference": ["api", "parameter", "specification", "reference", "command", "syntax", "function", "method", "class", "attribute", "property"],
    "Concept": ["what is", "overview", "introduction", "understanding", "concept", "about", "explanation", "theory", "background"],
}

TOKEN = r"[\p{L}\p{N}_']+"
SENTENCE = r"[^.!?\n]+[.!?]*"
#: A capitalised run that does not begin its sentence.
ENTITY = r"[\p{L}\p{N}_',;:)]\s+\p{Lu}[\p{L}\p{N}_']*(?:\s+\p{Lu}[\p{L}\p{N}_']*)*"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of the value, which is computed once, however often and however deep inside of element functions it is used.

    An expression used within a function of elements is otherwise computed again for each of them.
    """
    return F.element_at(F.transform(F.array(value), then), 1)


def inflected(verbs: list[str]) -> list[str]:
    """Each verb with its regular -s, -ed and -ing forms."""
    out: list[str] = []
    for v in verbs:
        stem = v[:-1] if v.endswith("e") else v
        third = v + "es" if v.endswith(("s", "x", "z", "ch", "sh")) else (v[:-1] + "ies" if v.endswith("y") and v[-2] not in "aeiou" else v + "s")
        past = v[:-1] + "ied" if v.endswith("y") and v[-2] not in "aeiou" else stem + "ed"
        out += [v, third, past, stem + "ing"]
    return sorted(set(out))


ACTION_FORMS = inflected(ACTION_VERBS)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return ~c.rlike(r"\S")


def escape_xml(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def slug(c: Column) -> Column:
    """An identifier of lower-case ASCII letters, digits, _ and -, that starts with a letter; `unnamed` if nothing is left."""
    kept = F.regexp_replace(F.lower(c), r"[^a-z0-9\s_-]", "")
    joined = F.trim(F.regexp_replace(kept, r"\s+", "_"), F.lit("_"))
    return F.when(joined == "", F.lit("unnamed")).when(F.substring(joined, 1, 1).between("a", "z"), joined).otherwise(F.concat(F.lit("id_"), joined))


def repaired_id(c: Column) -> Column:
    """The identifier that a repair makes of an ill-formed one: lower-cased, other characters as _."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9_\-.]", "_"), r"^_+|_+$", "")
    return F.when(kept == "", F.lit("unnamed")).when(kept.rlike("^[a-z]"), kept).otherwise(F.concat(F.lit("id_"), kept))


def fixed_id(c: Column) -> Column:
    """The identifier that the converter's own fix makes: case and edge underscores stay."""
    kept = F.regexp_replace(c, r"[^a-zA-Z0-9_\-.]", "_")
    return F.when(kept.rlike("^[a-zA-Z]"), kept).otherwise(F.concat(F.lit("id_"), kept))


def safe_name(c: Column, length: int = 50) -> Column:
    """Every character that is no letter or digit as _, cut to a length."""
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}]", "_"), 1, length)


def structural(c: Column) -> dict[str, Column]:
    """What the Markdown markup of a text shows."""
    fence = F.length(c) - F.length(F.replace(c, F.lit("```"), F.lit("")))
    headings = F.regexp_extract_all(c, F.lit(r"(?m)^(#{1,6})\s"), 1)
    has_code = c.contains("```")
    return {
        "has_numbered_list": c.rlike(r"(?m)^\d+\."),
        "has_bullet_list": c.rlike(r"(?m)^[-*+]\s"),
        "list_items": F.regexp_count(c, F.lit(r"(?m)^(\d+\.|\*|-|\+)\s")),
        "has_table": c.contains("|") & c.contains("---"),
        "table_count": ((F.length(c) - F.length(F.replace(c, F.lit("|---"), F.lit("")))) / 4).cast("int"),
        "has_code_block": has_code,
        "code_blocks": (fence / 6).cast("int"),
        "has_inline_code": c.contains("`") & ~has_code,
        "heading_count": F.size(headings),
        "max_heading_level": F.coalesce(F.array_max(F.transform(headings, F.length)), F.lit(0)),
        "has_links": c.rlike(r"\[.*?\]\(.*?\)"),
        "has_images": c.rlike(r"!\[.*?\]\(.*?\)"),
        "image_count": F.regexp_count(c, F.lit(r"!\[.*?\]\(.*?\)")),
        "char_count": F.length(c),
        "line_count": F.size(F.split(c, "\n")),
    }


# What `lexical` counts in a whole text, one match a sentence or name. They match what SENTENCE, TOKEN, ENTITY and
# DEFINITIONS tell of each sentence by itself: none of them goes on behind . ! ? or a line end.
_WORD_END, _REST = r"(?![\p{L}\p{N}_'])", r"[^.!?\n]*+"
#: A sentence whose first word is an action verb and that does not ask, from the character before it; a text gets a line end in front.
ORDERS = r"[.!?\n][^\p{L}\p{N}_.!?\n]*+(?=[" + "".join(sorted({v[0] for v in ACTION_VERBS})) + "])(?:" + "|".join(ACTION_VERBS) + ")" + _WORD_END + _REST + r"(?![.!?]*\?)"
#: A form of `be`, and what its sentence has behind it.
STATES = r"(?<![\p{L}\p{N}_'])(?:" + "|".join(BE_FORMS) + ")" + _WORD_END + _REST
#: A capitalised run, from the blanks before it.
NAMES = r"[ \t\x0B\f\r](?<=[\p{L}\p{N}_',;:)][ \t\x0B\f\r])[ \t\x0B\f\r]*+\p{Lu}[\p{L}\p{N}_']*+(?:[ \t\x0B\f\r]++\p{Lu}[\p{L}\p{N}_']*+)*+"
DEFINED = r"\b\w++ (?:" + "|".join(p.removeprefix(r"\b\w+ ").removesuffix("+") for p in DEFINITIONS) + ")"

#: The names of `lexical`'s counts.
LEXICAL = "word_count sentence_count avg_sentence_length action_verbs imperative_verbs is_statements has_definition named_entities verb_count noun_count".split()


#: Words of which a text must have one, or a form of `be`, to have a definition.
DEFINING = ["means", "refers", "represents"]


def words(c: Column) -> Column:
    """A struct of counts of a text's words: all, forms of action verbs and of `be`, stop words and words that define."""
    low = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 0)
    # Most words are of no kind; what is left is looked at again.
    known = lambda found: F.filter(found, lambda w: w.isin(*ACTION_FORMS, *BE_FORMS, *STOP_WORDS, *DEFINING))

    def counted(x: Column) -> Column:
        of = lambda names: F.size(F.filter(x["known"], lambda w: w.isin(*names)))
        return F.struct(x["all"].alias("all"), of(ACTION_FORMS).alias("actions"), of(BE_FORMS).alias("be"), of(STOP_WORDS).alias("stops"), of(DEFINING).alias("defining"))

    return let(low, lambda found: let(F.struct(F.size(found).alias("all"), known(found).alias("known")), counted))


def counts(c: Column, n: Column) -> dict[str, Column]:
    """The counts of words and sentences in a text by name, where `n` has what `words` tells of it.

    A sentence is a piece between . ! ? and line ends that has a letter. A verb is a form of an action verb or of
    `be`; every other word that is no stop word counts as a noun. Each is a column of its own, made only where it is
    used; a text without the words that a pattern asks for is not searched for it.
    """
    # The pieces are counted in place, by patterns that take up a sentence from where it tells something to its end.
    count = lambda t, p: F.regexp_count(t, F.lit(p))
    low, sentences = F.lower(c), count(c, r"\p{L}[^.!?\n]*+")
    return {
        "word_count": n["all"],
        "sentence_count": sentences,
        "avg_sentence_length": F.when(sentences > 0, n["all"] / sentences).otherwise(F.lit(0.0)),
        "action_verbs": n["actions"],
        # A quote before a verb belongs to the word, but not to what an order starts with.
        "imperative_verbs": F.when((n["actions"] == 0) & ~c.contains("'"), F.lit(0)).otherwise(count(F.concat(F.lit("\n"), low), ORDERS)),
        "is_statements": F.when(n["be"] == 0, F.lit(0)).otherwise(count(low, STATES)),
        "has_definition": F.when(n["be"] + n["defining"] == 0, F.lit(False)).otherwise(low.rlike(DEFINED)),
        "named_entities": count(c, NAMES),
        "verb_count": n["actions"] + n["be"],
        "noun_count": F.greatest(F.lit(0), n["all"] - n["actions"] - n["be"] - n["stops"]),
    }


def lexical(c: Column) -> Column:
    """A struct of the counts of `counts`: an approximation without a tagger."""
    return let(words(c), lambda n: F.struct(*[v.alias(name) for name, v in counts(c, n).items()]))
