"""Stems of English words by Porter's rules, as column expressions and as SQL.

A step is a list of rules (test, pattern, replacement): of a step the first rule whose test
a word meets is the one that may change it.  Vowels are aeiou, and y after a consonant; a y
that is a consonant is written Y while the rules run.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

V, C = "[aeiouy]", "[^aeiouy]"
ANY, VOWEL = ".*", f".*{V}.*"
ONE = f"{C}*{V}+{C}.*"  # at least one vowel group and consonant group
TWO = f"{C}*{V}+{C}+{V}+{C}.*"
SHORT = f"{C}+{V}[^aeiouywxY]"  # one such group that ends consonant, vowel, consonant
SHORTEST, LONGEST = 3, 64  # letters of words that have stems


def _suffixes(stem: str, table: dict[str, str]) -> list[tuple[str, str, str]]:
    return [(f"{s}$", f"^({stem}){s}$", "$1" + to) for s, to in sorted(table.items(), key=lambda kv: -len(kv[0]))]


#: The suffixes of the published algorithm, as its revision has them.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()

STEPS = [
    [("^y", "^y", "Y")],
    [("[aeiou]y", "([aeiou])y", "$1Y")],
    [("yy", "yy", "yY")],
    [(".sses$", "sses$", "ss"), (".ies$", "ies$", "i"), ("ss$", "ss$", "ss"), ("s$", "s$", "")],
    # ~ where an ending went that calls for repairs
    [("eed$", f"^({ONE})eed$", "$1ee"), ("ed$", f"^({VOWEL})ed$", "$1~"), ("ing$", f"^({VOWEL})ing$", "$1~")],
    [*_suffixes(ANY, {"at~": "ate", "bl~": "ble", "iz~": "ize"}), *[(f"{c}{c}~$", f"{c}{c}~$", c) for c in "bcdfghjkmnpqrtvwxY"], (f"^{SHORT}~$", "~$", "e"), ("~$", "~$", "")],
    [("[yY]$", f"^({VOWEL})[yY]$", "$1i")],
    _suffixes(ONE, SECOND),
    _suffixes(ONE, THIRD),
    [*_suffixes(TWO, dict.fromkeys((s for s in FOURTH if len(s) > 3), "")), ("[st]ion$", f"^({TWO})ion$", "$1"), *_suffixes(TWO, dict.fromkeys((s for s in FOURTH if len(s) <= 3), ""))],
    [(f"^{TWO}e$", "e$", ""), (f"^{SHORT}e$", "e$", "e"), (f"^{C}*{V}+{C}+{V}*e$", "e$", "")],
    [("ll$", f"^({TWO})l$", "$1")],
]


def stem(word: Column) -> Column:
    """Stem of a lower-case word; words of two letters, or of very many, are their own."""
    now = word
    for step in STEPS:
        now = _first(now, step)
    return F.when(F.length(word).between(SHORTEST, LONGEST), F.lower(now)).otherwise(word)


def _first(word: Column, step: list[tuple[str, str, str]]) -> Column:
    def rule(w: Column) -> Column:
        out = None
        for test, pattern, to in step:
            held = w.endswith(test[:-1]) if test[:-1].isalpha() and test.endswith("$") else w.rlike(test)
            then = F.regexp_replace(w, pattern, to)
            out = F.when(held, then) if out is None else out.when(held, then)
        return out.otherwise(w)

    # the word of a step is worked out once, however many rules look at it
    return F.element_at(F.transform(F.array(word), rule), 1)


#: Rules as Python takes them; a test without signs is an ending.
_RULES = [[(t[:-1] if t[:-1].isalpha() and t.endswith("$") else re.compile(t), re.compile(p), to.replace("$1", r"\1")) for t, p, to in step] for step in STEPS]

#: What some rule's test asks of a word; without it no rule changes anything.
_TOUCHED = re.compile("y|(?:s|e|i|al|ll|ed|ing|er|ator|ion|ism|ic|ant|ent|ou|ful)$")


@lru_cache(1 << 17)
def stem_of(word: str | None) -> str | None:
    """The same stem of one word, by the same rules."""
    if word is None or not SHORTEST <= len(word) <= LONGEST:
        return word
    if not _TOUCHED.search(word):
        return word.lower()
    now = word
    for step in _RULES:
        for test, pattern, to in step:
            if now.endswith(test) if isinstance(test, str) else test.search(now):
                now = pattern.sub(to, now)
                break
    return now.lower()


@F.arrow_udf(ArrayType(StringType()))
def stems_of(words: pa.Array) -> pa.Array:
    """Stems of an array of words, in their places; a batch works out each word once."""
    coded = words.flatten().dictionary_encode()
    found = pa.array([stem_of(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    sizes = words.value_lengths().fill_null(0).to_pylist()
    ends = [0]
    for n in sizes:
        ends.append(ends[-1] + n)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found, mask=words.is_null())


def stem_table(words: DataFrame) -> DataFrame:
    """``term`` and ``stem`` of every different ``term``."""
    return words.select("term").distinct().select("term", stem(F.col("term")).alias("stem"))


def may_have_stem(word: Column, of: str) -> Column:
    """False for most words that have another stem than ``of``, at little cost: rules change
    ends, so that all of a stem but its last letter starts the word."""
    return word.startswith(of[:-1])


def stem_table_sql(source: str, name: str = "stems") -> str:
    """The same table in DuckDB: common table expressions that end in ``name``."""
    out = [f"{name}_0 AS (SELECT DISTINCT term, term AS w FROM {source})"]
    for k, step in enumerate(STEPS, 1):
        rules = " ".join(f"WHEN regexp_matches(w, '{test}') THEN regexp_replace(w, '{pattern}', '{to.replace('$1', chr(92) + '1')}'{', ' + repr('g') if k == 2 else ''})" for test, pattern, to in step)
        out.append(f"{name}_{k} AS (SELECT term, CASE {rules} ELSE w END AS w FROM {name}_{k - 1})")
    return ",\n".join([*out, f"{name} AS (SELECT term, CASE WHEN length(term) BETWEEN {SHORTEST} AND {LONGEST} THEN lower(w) ELSE term END AS stem FROM {name}_{len(STEPS)})"])
