"""String columns: lines, words, names, summaries, identities. All of them are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that summaries are compared without (fixed values).
STOPWORDS = "a an the of to in on at for by with and or but is are was be it its this that now so as from into".split()


def line_count(text: Column) -> Column:
    """Physical lines; a newline at the end opens no further line, and an empty text has none."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(breaks + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("long")


def non_blank_lines(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))), F.lit(0)).cast("long")


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))


def words(text: Column) -> Column:
    """Identifier words in lower case: split at case changes and at everything but letters and digits."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: w != "")


def singular(word: Column) -> Column:
    plural = (F.length(word) > 3) & word.endswith("s") & ~word.rlike("(ss|is|us|as)$")
    return F.when(plural, F.left(word, F.length(word) - 1)).otherwise(word)


def name_stem(path: Column, folder_word: Column | None = None) -> Column:
    """The words that a file's name leads with: one, or two when the first has three letters or fewer, or is its folder's word."""
    stem = F.split_part(F.substring_index(path, "/", -1), F.lit("."), F.lit(1))
    # Affixes of tests and hooks (fixed values).
    stem = F.regexp_replace(stem, "^(smoke[-_]?)?tests?[-_]|[-_](test|spec)s?$|(Tests?|Spec|IT)$", "")
    stem = F.regexp_replace(stem, "^use(?=[A-Z_-])", "")
    spaced = F.regexp_replace(F.regexp_replace(stem, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    found = F.filter(F.split(F.lower(spaced), r"[\s_-]+"), lambda w: w.rlike("[a-z]"))
    says_little = F.length(F.get(found, 0)) <= 3
    if folder_word is not None:
        says_little |= singular(F.get(found, 0)) == folder_word
    lead = F.slice(found, 1, F.when(says_little, 2).otherwise(1))
    return F.array_join(F.transform(lead, singular), " ")


def ordinal(n: Column) -> Column:
    suffix = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4).cast("long")


def criterion_key(text: Column) -> Column:
    """Letters and digits in lower case, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def normal_summary(summary: Column) -> Column:
    """Lower case without punctuation, stop words and bare numbers; identifiers stay whole.

    Patterns over the whole text and not a lambda over its words, which would not be compiled.
    """
    plain = F.regexp_replace(F.lower(summary), "[^a-z0-9_.$]+", " ")
    bare = F.regexp_replace(plain, r"(?<![^ ])\.+|\.+(?![^ ])", "")
    kept = F.regexp_replace(bare, rf"(?<![^ ])(?:[0-9]+|{'|'.join(STOPWORDS)})(?![^ ])", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word arrays: shared over all; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / F.size(F.array_union(a, b)))


def content_id(*parts: Column, length: int = 32) -> Column:
    """A name made of the parts themselves: hexadecimal digits of a SHA-256, with zero characters between."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, length)


def stable_uuid(seed: Column) -> Column:
    """The SHA-1 of the seed in the layout of a UUID."""
    h = F.sha1(seed)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits."""
    n = F.length(text)
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda total, c: total - (share := F.size(F.filter(chars, lambda x: x == c)) / n) * F.log2(share))
    return F.when(n > 0, bits).otherwise(0.0)


def shell_words(line: Column) -> Column:
    """The words of a command line: quotes hold blanks together, and within double ones a backslash keeps the next character."""
    quoted, single = r'"(?:[^"\\]|\\.)*"?', r"'[^']*'?"
    found = F.regexp_extract_all(line, F.lit(rf"""((?:[^\s"']|{quoted}|{single})+)"""), F.lit(1))

    def bare(word: Column) -> Column:
        parts = F.regexp_extract_all(word, F.lit(rf"""([^"']+|{quoted}|{single})"""), F.lit(1))
        inner = F.transform(parts, lambda p: F.when(p.startswith('"'), F.regexp_replace(F.regexp_replace(p, r'^"|(?<!\\)((?:\\\\)*)"$', "$1"), r"\\(.)", "$1")).when(p.startswith("'"), F.regexp_replace(p, "^'|'$", "")).otherwise(p))
        return F.array_join(inner, "")

    return F.transform(found, bare)


#: What single letters stand for behind a backslash in quoted paths, as bytes (fixed values).
ESCAPED_BYTES = {"n": "0A", "t": "09", "r": "0D", "a": "07", "b": "08", "f": "0C", "v": "0B"}


def unquoted_path(path: Column) -> Column:
    """A path as a version control tool quotes it, with octal bytes and escapes, as it is; one without quotes stays."""
    body = F.substr(path, F.lit(2), F.length(path) - 2)
    parts = F.regexp_extract_all(body, F.lit(r"(\\[0-7]{1,3}|\\.|[^\\]+)"), F.lit(1))
    letters = F.create_map(*[F.lit(x) for pair in ESCAPED_BYTES.items() for x in pair])

    def as_hex(p: Column) -> Column:
        octal = F.right(F.lpad(F.conv(F.substr(p, F.lit(2)), 8, 16), 2, "0"), F.lit(2))
        return F.when(p.rlike(r"^\\[0-7]"), octal).when(p.startswith("\\"), F.coalesce(letters[F.substr(p, F.lit(2))], F.hex(F.encode(F.substr(p, F.lit(2)), "UTF-8")))).otherwise(F.hex(F.encode(p, "UTF-8")))

    whole = path.startswith('"') & path.endswith('"') & (F.length(path) > 1)
    return F.when(whole, F.decode(F.unhex(F.array_join(F.transform(parts, as_hex), "")), "UTF-8")).otherwise(path)
