"""Text expressions: question formats, templates, entities, answers. All are built-in Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classes of foreign objects that questions name.
FO_CLASSES = ("Sponge", "Clip", "Specimen Bag", "Silicone Loop", "External Drain", "Needle", "Gallstone", "Specimen", "Mesh")

TIMESTAMP = r"[0-9]{1,2}:[0-9]{2}:[0-9]{2}"


#: A word's edge. Words are made of ASCII letters, digits and the underscore alone, as in SQL; Java's own edge is not
#: found beside other letters.
EDGE = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
#: Letters that have a third form where case is ignored: the long s and the sign of Kelvin.
FORMS = {"s": "[sS\u017f]", "k": "[kK\u212a]"}


def pattern(p: str) -> str:
    """A pattern that finds in Java what other engines (RE2) find: edges of words in ASCII, case as in Unicode."""
    if re.match(r"\(\?[a-z]*i", p):
        p = re.sub(r"\(\?[a-z]+\)|\\.|\[[^\]]*\]|[sSkK]", lambda m: FORMS.get(m[0].lower(), m[0]), p)
    return edged(p)


def edged(p: str) -> str:
    return p.replace(r"\b", EDGE)


def found(text: Column, p: str) -> Column:
    return F.rlike(text, F.lit(pattern(p)))


def seeded(seed: str, key: Column) -> Column:
    """A hash in hexadecimal that other engines compute alike; its order is a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def coin(seed: str, key: Column, share: float) -> Column:
    """True for about ``share`` of the keys, always the same ones."""
    return F.substring(seeded(seed, key), 1, 8) < F.lit(f"{min(int(share * 2**32), 2**32 - 1):08x}")


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None, find=found) -> Column:
    """The name of the first rule whose pattern is found; the order of rules decides."""
    out = F.lit(default)
    for name, p in reversed(rules):
        out = F.when(find(text, p), name).otherwise(out)
    return out


# The set phrases by which a question asks for its answer's format; the order decides.
FORMAT_RULES = [
    ("percentage", r"(?is)\bin\s*%|xx%|percentage"),
    ("open_ended", r"(?is)provide a single integer"),
    ("open_ended", r"(?is)answer (with )?['‘’\"]none['‘’\"]"),
    ("open_ended", r"(?is)yes or no.{0,60}(reason|explain|explanation|sentence)"),
    ("multiple_choice", r"(?is)please select"),
    ("time", r"(?is)hh:mm:ss|provide the time"),
    ("number", r"(?is)provide (a|the) number"),
    ("fo_class", r"(?is)answer (with )?none\b|provide (a|the) class name"),
    ("binary", r"(?is)answer with yes or no"),
]
TOPIC = r"(?i)foreign object|\bfo\b|sponge|clip|specimen|silicone loop|external drain|needle|gallstone|\bmesh\b|instrument"


def on_topic(question: Column, form: Column) -> Column:
    return (form == "fo_class") | found(question, TOPIC)


def question_format(question: Column, rules: list[tuple[str, str]] = FORMAT_RULES) -> Column:
    return first_match(question, rules, "open_ended", lambda q, p: F.rlike(q, F.lit(edged(p))))


def options(question: Column) -> Column:
    """The options of a menu: what stands behind the colon after ``please select``, split at semicolons."""
    at = F.instr(F.lower(question), F.lit("please select"))
    menu = F.when(at > 0, F.substring(question, at, F.length(question)))
    listed = F.when(F.instr(menu, F.lit(":")) > 0, F.substring(menu, F.instr(menu, F.lit(":")) + 1, F.length(menu)))
    return F.filter(F.transform(F.split(F.rtrim(F.btrim(F.coalesce(listed, F.lit("")), F.lit(" \t\n\r")), F.lit(".")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def folded(text: Column, names: tuple[str, ...] = FO_CLASSES) -> Column:
    """A template: times become ``<TS>``, numbers ``<N>``, class names (long ones first, plurals too) ``<FO>``."""
    out = F.regexp_replace(F.regexp_replace(text, r"[0-9]{2}:[0-9]{2}:[0-9]{2}", "<TS>"), pattern(r"\b[0-9]+(\.[0-9]+)?\b"), "<N>")
    for n in sorted(names, key=lambda n: (-len(n), n)):
        plural = "es" if n.endswith("sh") else "s"
        out = F.replace(F.replace(out, F.lit(n + plural), F.lit("<FO>")), F.lit(n), F.lit("<FO>"))
    return F.trim(out)


def leading_words(text: Column, n: int = 8) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, n), " ")


def entities(text: Column, names: tuple[str, ...]) -> Column:
    """Names found, longest first; what is found is taken out before shorter names are looked for."""
    dictionary = F.array(*[F.lit(n.lower()) for n in sorted(names, key=lambda n: (-len(n), n))])
    start = F.struct(F.lower(text).alias("rest"), F.filter(dictionary, lambda x: F.lit(False)).alias("hits"))

    def step(a: Column, n: Column) -> Column:
        return F.when(F.instr(a["rest"], n) > 0, F.struct(F.replace(a["rest"], n, F.lit(" ")).alias("rest"), F.concat(a["hits"], F.array(n)).alias("hits"))).otherwise(a)

    return F.aggregate(dictionary, start, step, lambda a: a["hits"])


def mask_mode(question: Column) -> Column:
    """``and`` if the question wants both together, else ``or``."""
    return F.when(found(question, r"(?i)\bboth\b|at the same time|simultaneously|together"), "and").otherwise("or")


def edge_kind(question: Column) -> Column:
    return F.when(found(question, r"(?i)\bfirst\b"), "first").when(found(question, r"(?i)\blast\b"), "last").otherwise("other")


def ordinal(n: Column) -> Column:
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def stem(path: Column) -> Column:
    """The last part of a path without its last ending."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def canonical_list(text: Column) -> Column:
    """Parts of a comma list in order, joined again; repeats stay."""
    return F.array_join(F.sort_array(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")), ", ")


def replaced_word(text: Column, old: str, new: str) -> Column:
    """A word replaced in lower and in title case."""
    return F.regexp_replace(F.regexp_replace(text, pattern(rf"\b{old.title()}\b"), new.title()), pattern(rf"\b{old}\b"), new)


def distinct_list(text: Column) -> Column:
    """Parts of a comma list, the first of those that differ in case alone, in their order.

    Parts that differ in case alone lie side by side once sorted; each list is made once, as a name of a lambda.
    """
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    marked = F.sort_array(F.transform(parts, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x"))))
    firsts = F.transform(F.array(marked), lambda m: F.filter(m, lambda p, j: F.coalesce(F.get(m, j - 1)["low"] != p["low"], F.lit(True))))[0]
    return F.array_join(F.transform(F.sort_array(F.transform(firsts, lambda p: F.struct(p["i"], p["x"]))), lambda p: p["x"]), ", ")


#: Marks that may trail an answer.
TRAIL = " \t\n.。、,；;:：!！?？'\"`*"


#: The short answer of a format is what its first pattern with a match captures.
_ENDS = r"[ \t\n.。、,；;:：!！?？'\"`*]*"
SHORT_ANSWERS = {
    "number": (r"([0-9]+)",),
    "percentage": (r"([0-9]+(?:\.[0-9]+)?)",),
    "binary": (rf"(?i)^{_ENDS}(yes|no){_ENDS}$", r"(?i)^\s*(yes|no)\b"),
}
#: A word that may be a class nobody has named yet.
UNNAMED = r"[A-Za-z][A-Za-z /-]{0,29}"


def normalised(answer: Column, form: str, classes: tuple[str, ...] = FO_CLASSES, first_line: bool = False, unknown: bool = False) -> Column:
    """An answer brought into its format's shape; what does not fit stays as it is.

    ``first_line`` cuts it at the first line end; ``unknown`` takes class-like words beside the classes.
    """
    text = F.trim(F.substring_index(F.trim(answer), "\n", 1) if first_line else answer)
    if form in SHORT_ANSWERS:
        found = [F.nullif(F.lower(F.regexp_extract(text, edged(p), 1)), F.lit("")) for p in SHORT_ANSWERS[form]]
        return F.coalesce(*found, text)
    if form != "fo_class":
        return text
    # a list is rewritten if every part of it is in one of the vocabularies, "none" standing for all
    named = f"(?i)^(?:{'|'.join((*classes, 'none'))})$"
    parts = F.filter(F.transform(F.split(text, ","), lambda c: F.btrim(c, F.lit(TRAIL))), lambda x: x != "")
    every = lambda pattern: (F.size(parts) > 0) & F.forall(parts, lambda x: F.rlike(x, F.lit(pattern)))
    joined = F.when(F.exists(parts, lambda x: F.rlike(x, F.lit("(?i)^none$"))), "none").otherwise(F.array_join(parts, ", "))
    return F.when(every(named), joined).when(every(f"^{UNNAMED}$") if unknown else F.lit(False), F.array_join(parts, ", ")).otherwise(text)


def quadrant(x: Column, y: Column, width: Column, height: Column) -> Column:
    """top/bottom and left/right of a point; the middle counts as bottom and right."""
    return F.concat(F.when(y * 2 < height, "top").otherwise("bottom"), F.lit("/"), F.when(x * 2 < width, "left").otherwise("right"))
