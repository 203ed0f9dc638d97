"""Declarations by line: one rule for each family of languages, put together from keyword lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that may stand before what is declared.
MODIFIERS = "export default declare public protected private internal pub abstract static final async override open sealed data readonly unsafe extern virtual inline suspend".split()
#: What declares a callable, a type and a value. A class counts as a callable: what others depend on is how it is called.
CALLABLE = "function def fn func fun class".split()
TYPE = "interface type enum struct trait record typealias".split()
VALUE = "const let var static".split()

NAME = r"([A-Za-z_$][\w$]*)"
LEAD = rf"^\s*(?:(?:{'|'.join(MODIFIERS)})(?:\([^)]*\))?\s+)*"
#: kind and pattern, in the order in which they are tried. A function's name may follow its receiver, and a constant that holds a function is a callable.
RULES = (
    ("callable", rf"{LEAD}(?:{'|'.join(CALLABLE)})\*?\s+(?:\([^)]*\)\s*)?{NAME}"),
    ("type", rf"{LEAD}(?:const\s+)?(?:{'|'.join(TYPE)})\s+{NAME}"),
    ("callable", rf"{LEAD}(?:const|let|var)\s+{NAME}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)?.*=>|\([^)]*$|[\w$]+\s*=>)"),
    ("value", rf"{LEAD}(?:{'|'.join(VALUE)})\s+{NAME}"),
)


def indent(line: Column) -> Column:
    """Blanks before the first character; a tab counts as four."""
    return F.length(F.replace(F.regexp_extract(line, r"^([ \t]*)", 1), F.lit("\t"), F.lit("    ")))


def declared(line: Column) -> Column:
    """kind and name of what the line declares; null if nothing."""
    found = F.coalesce(*[F.when(line.rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(line, p, 1).alias("name"))) for kind, p in RULES])
    return found


def is_declaration(line: Column) -> Column:
    return F.coalesce(*[F.when(line.rlike(p), True) for _, p in RULES], F.lit(False))


def plain_form(text: Column) -> Column:
    """What two versions of a declaration are compared by: without the blanks that mean nothing and what opens a body."""
    tight = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r" ?([(){}\[\],:;<>=|&?]) ?", "$1")
    return F.trim(F.regexp_replace(tight, r"[{;,]+$", ""))
