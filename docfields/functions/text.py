"""String column functions: whitespace, pattern translation and quoting.

The rule patterns follow the Unicode-aware conventions of Python's ``re``. Spark evaluates Java patterns, so
``search_pattern`` and ``match_pattern`` rewrite the few constructs on which the two engines disagree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that ``str.isspace`` accepts; Java's \s differs with and without (?U).
WHITESPACE = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_BLANKS = "".join(char for char in map(chr, range(0x3001)) if char.isspace())
_WORD = r"[\p{L}\p{N}_]"


def _portable(pattern: str) -> str:
    """The parts of the translation that do not concern letter case.

    * Gaps become possessive. Nothing that follows a gap in the rules can start with whitespace, so the
      matches stay the same, while a long run of blanks costs linear instead of polynomial time.
    * ``\\b`` becomes a look-around on Unicode letters, digits and the underscore.
    """
    out = pattern.replace(r"\s*", f"[{WHITESPACE}]*+")
    out = out.replace(r"[\s", f"[{WHITESPACE}")
    if out.endswith(r"\b"):
        out = out[:-2] + f"(?!{_WORD})"
    return out.replace(r"\b", f"(?<!{_WORD})")


def search_pattern(pattern: str) -> str:
    """Java form of a case-insensitive search pattern.

    ``[A-Z]`` lists both cases, because Java folds a range in one direction only.
    """
    return "(?iu)" + _portable(pattern).replace("[A-Z]", "[A-Za-z]")


def folded(text: Column) -> Column:
    """Lower-case text in which every letter that matches an ASCII letter regardless of case is that letter.

    Lower case alone leaves three such letters: dotted capital I, dotless small i and long s.
    """
    for letter, plain in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s")):
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.lower(text)


def folded_pattern(pattern: str) -> str:
    """Java form of a case-insensitive search pattern for folded text, where it may be case-sensitive."""
    return _portable(pattern).replace("[A-Z]", "[a-z]")


def match_pattern(pattern: str) -> str:
    """Java form of an anchored format rule: ``$`` may be followed by one final newline only."""
    return pattern.removesuffix("$") + r"\n?\z"


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace; looks at the two ends only."""
    return F.trim(text, F.lit(_BLANKS))


def quoted(text: Column) -> Column:
    """The text as a Python string literal, the form in which messages show a value."""
    plain = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    plain = F.replace(plain, F.lit("\n"), F.lit("\\n"))
    plain = F.replace(plain, F.lit("\r"), F.lit("\\r"))
    plain = F.replace(plain, F.lit("\t"), F.lit("\\t"))
    hidden = r"[\p{C}\p{Z}&&[^ ]]"
    escaped = F.array_join(F.transform(F.split(plain, ""), _escape_hidden), "")
    plain = F.when(plain.rlike(hidden), escaped).otherwise(plain)
    use_double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return (
        F.when(use_double, F.concat(F.lit('"'), plain, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )


def _escape_hidden(char: Column) -> Column:
    code = F.lower(F.hex(F.ascii(char).cast("bigint")))
    return (
        F.when(~char.rlike(r"[\p{C}\p{Z}&&[^ ]]"), char)
        .when(F.length(code) <= 2, F.concat(F.lit("\\x"), F.lpad(code, 2, "0")))
        .when(F.length(code) <= 4, F.concat(F.lit("\\u"), F.lpad(code, 4, "0")))
        .otherwise(F.concat(F.lit("\\U"), F.lpad(code, 8, "0")))
    )
