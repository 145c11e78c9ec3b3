"""Rule-based grading of submitted answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.functions.numbers import NUMBER_PATTERN

ERROR_PREFIX = "ERROR:"


def auto_grade(answer: Column) -> Column:
    """Grade and reason of an answer that needs no reading, else null."""
    failed = answer.startswith(ERROR_PREFIX)
    empty = F.coalesce(F.trim(answer), F.lit("")) == ""
    def wrong(why: str) -> Column:
        return F.struct(F.lit("INCORRECT").alias("grade"), F.lit(why).alias("reasoning"))

    return F.when(failed, wrong("the request failed")).when(empty, wrong("no answer was given"))


def normalised(answer: Column) -> Column:
    """Lower case, single blanks, no quotes, brackets or closing full stop."""
    return _folded(_bare(answer))


def _bare(answer: Column) -> Column:
    return F.regexp_replace(F.lower(answer), r"[\[\]\"'`*]", "")


def _folded(text: Column) -> Column:
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.trim(F.regexp_replace(text, r"\.$", ""))


def _spelled(word: Column) -> Column:
    """Numbers in one spelling; other words as they are."""
    return F.when(word.rlike(NUMBER_PATTERN), F.coalesce(word.try_cast("double").cast("string"), word)
                  ).otherwise(word)


def parts(answer: Column) -> Column:
    """Comma-separated parts, numbers in one spelling."""
    return _parts(normalised(answer))


def _parts(normal: Column) -> Column:
    pieces = F.transform(F.split(normal, ","), lambda p: F.trim(p))
    return F.transform(F.filter(pieces, lambda p: p != ""), _spelled)


# Words that deny what stands after them in the same clause.
DENIALS = ["no", "not", "never", "neither", "nor", "isn't", "isnt"]
# Verdicts that a question about a trend can be answered with.
VERDICTS = ["improved", "worsened", "mixed", "unchanged"]
_CLAUSE_ENDS = r"[,;:.!?](?=\s|$)|\s(?:but|so|then)\s"
_ITEM_ENDS = r"[,;\n]|\s(?:and|at|&)\s"
#: What numbers or marks the entries of a list.
_MARKS = r"^\s*(?:\d+\s*[.)]\s+|[-\u2022]\s+)"


def words(answer: Column) -> Column:
    """Words of an answer: letters, digits and signs inside; numbers in one spelling."""
    return _words(normalised(answer))


def _words(normal: Column) -> Column:
    plain = F.regexp_replace(normal, r"[^\p{L}\p{N}_.\-/&]+|(?<=\s)&(?=\s)", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"[/&]", " / "), r"[.\-]+(?=\s|$)", "")
    return F.transform(F.filter(F.split(plain, r"\s+"), lambda w: w != ""), _spelled)


def place_of(said: Column, sought: Column) -> Column:
    """Where in ``said`` (from 1) the words ``sought`` first stand one after the other, or 0."""
    size = F.size(sought)
    hits = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(said), F.lit(1))),
        lambda i: F.slice(said, i, size) == sought,
    )
    return (
        F.when(size == 1, F.array_position(said, F.get(sought, F.lit(0))).cast("int"))
        .when((size > 1) & F.array_contains(said, F.get(sought, F.lit(0))),
              F.coalesce(F.get(hits, F.lit(0)), F.lit(0)))
        .otherwise(0)
    )


def _bound(value: Column, use) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def affirms(said: Column, sought: Column) -> Column:
    """Some words have the expected ones among them, and no denial before them.

    YES and NO have to be the first or last word, as they also stand in other phrases.
    """
    choice = sought.isin(F.array(F.lit("yes")), F.array(F.lit("no")))

    def stands(at: Column) -> Column:
        before = F.slice(said, 1, F.greatest(at - 1, F.lit(0)))
        denied = F.arrays_overlap(before, F.array(*[F.lit(d) for d in DENIALS]))
        return (at > 0) & ~denied & (~choice | (at == 1) | (at == F.size(said)))

    return _bound(place_of(said, sought), stands)


def hedges(said: Column, sought: Column, options: Column) -> Column:
    """The words offer something else beside the expected ones.

    That is another word next to them behind "or" or a slash, another option next to them behind
    "and", another option before them, or another verdict anywhere, unless it is denied. Options
    are the words that the question asks about, if known; without them a bare "this and that"
    offers two.
    """
    size = F.size(sought)

    def offered(at: Column) -> Column:
        after, before = F.get(said, at + size - 1), F.get(said, at - 2)
        next_one, last_one = F.get(said, at + size), F.get(said, at - 3)
        known = F.size(options) > 0

        def other(link: Column, word: Column) -> Column:
            either = link.isin("or", "/") & word.isNotNull()
            bare = ~known & (F.size(said) == size + 2)
            return F.coalesce(
                either | ((link == "and") & word.isNotNull()
                          & (bare | F.array_contains(options, word))), F.lit(False))

        return (at > 0) & (other(after, next_one) | other(before, last_one))

    rest = F.array_except(options, sought)
    verdict = sought.isin(*[F.array(F.lit(v)) for v in VERDICTS])

    def first(at: Column) -> Column:
        return F.exists(rest, lambda w: affirms(said, F.array(w)) & (
            verdict | (F.array_position(said, w) < at)))

    return _bound(place_of(said, sought), lambda at: offered(at) | first(at))


def items(answer: Column) -> Column:
    """Parts of a list that commas, semicolons, line ends, "and" or "at" separate.

    Numbers and marks in front of the parts are left out where every line has one.
    """
    lines = F.filter(F.split(_bare(answer), r"\r?\n"), lambda x: F.trim(x) != "")
    marked = (F.size(lines) > 1) & F.forall(lines, lambda x: x.rlike(_MARKS))
    lines = F.when(marked, F.transform(lines, lambda x: F.regexp_replace(x, _MARKS, ""))
                   ).otherwise(lines)
    pieces = F.flatten(F.transform(lines, lambda x: F.split(_folded(x), _ITEM_ENDS)))
    return F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != "")


def _listed(answer: Column, expected: Column, ordered: bool) -> Column:
    def graded(s: Column) -> Column:
        given, wanted, pieces, sought = s["given"], s["wanted"], s["pieces"], s["sought"]
        # Each wanted part in its own piece of the answer, with whatever words around it.
        if ordered:
            in_order = (F.size(pieces) == F.size(sought)) & F.forall(
                F.zip_with(pieces, sought, affirms), lambda hit: hit)
            right = (given == wanted) | in_order
        found = F.filter(sought, lambda w: F.exists(pieces, lambda p: affirms(p, w)))
        shared = F.greatest(F.size(F.array_intersect(given, wanted)),
                            F.size(F.array_distinct(found)))
        if not ordered:
            many = F.size(F.array_distinct(wanted))
            right = (shared == many) & (
                (F.size(F.array_distinct(given)) == many)
                | (F.size(F.array_distinct(pieces)) == many))
        return F.when(right, "CORRECT").when(shared > 0, "PARTIAL").otherwise("INCORRECT")

    wanted = _parts(normalised(expected))
    return _bound(F.struct(
        _parts(normalised(answer)).alias("given"), wanted.alias("wanted"),
        F.transform(items(answer), _words).alias("pieces"),
        F.transform(wanted, _words).alias("sought")), graded)


def _spoken(answer: Column, expected: Column, question: Column) -> Column:
    """CORRECT where the answer is the expected text, or a clause of it or the whole affirms that
    text and offers no other."""
    def graded(s: Column) -> Column:
        sought = s["sought"]
        options = F.when(
            sought.isin(*[F.array(F.lit(v)) for v in VERDICTS]),
            F.array(*[F.lit(v) for v in VERDICTS]),
        ).when(
            sought.isin(F.array(F.lit("yes")), F.array(F.lit("no"))), F.array().cast("array<string>")
        ).otherwise(s["asked"])
        said = F.exists(s["clauses"], lambda c: affirms(c, sought))
        whole = (F.size(sought) > 1) & affirms(s["said"], sought)
        beside = F.exists(s["clauses"], lambda c: hedges(c, sought, options))
        return F.when((s["said"] == sought) | ((said | whole) & ~beside), "CORRECT").otherwise(
            "INCORRECT")

    # Short words of the question, such as names of groups, that stand apart in capitals or digits.
    capitals = F.regexp_extract_all(
        F.coalesce(question, F.lit("")), F.lit(r"(?<=\s|^|[\"'(])([A-Z0-9]{1,3})(?=\s|$|[\"'),.?])"), 1)
    asked = F.transform(F.array_distinct(capitals), lambda w: _spelled(F.lower(w)))
    normal = normalised(answer)
    return F.when(normal == normalised(expected), "CORRECT").otherwise(_bound(F.struct(
        _words(normal).alias("said"),
        F.transform(F.split(normal, _CLAUSE_ENDS), _words).alias("clauses"),
        words(expected).alias("sought"), asked.alias("asked")), graded))


def rule_grade(
    answer_format: Column, answer: Column, expected: Column, question: Column | None = None
) -> Column:
    """CORRECT, PARTIAL or INCORRECT by the rules of the answer format."""
    question = F.lit(None).cast("string") if question is None else question
    return (
        F.when(answer_format.isin("feature_ranked_list", "column_value", "row"),
               _listed(answer, expected, True))
        .when(answer_format == "column_pair", _listed(answer, expected, False))
        .otherwise(_spoken(answer, expected, question))
    )


def grade(results: DataFrame) -> DataFrame:
    """Add ``grade`` and ``reasoning`` to evaluation records."""
    automatic = auto_grade(F.col("model_answer"))
    question = F.col("question") if "question" in results.columns else None
    ruled = rule_grade(
        F.col("answer_format"), F.col("model_answer"), F.col("expected_answer"), question)
    why = F.concat(F.lit("compared as "), F.coalesce("answer_format", F.lit("text")))
    graded = results.withColumn("_auto", automatic)
    return graded.withColumns({
        "grade": F.coalesce("_auto.grade", ruled),
        "reasoning": F.coalesce("_auto.reasoning", why),
    }).drop("_auto")
