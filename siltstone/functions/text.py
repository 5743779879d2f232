"""Text normal forms, identities, n-grams and overlap as column expressions.

Normal forms (they are not interchangeable): ``words_form`` (NFKC, lower case,
ASCII alphanumeric tokens, numbers kept or masked), ``spaces_form`` (NFKC, one
space for any run of white space), ``folded_form`` and ``lower_form`` (case
folded or lowered, white space collapsed), ``signature_form`` (quotes and numbers
replaced). Everything stays in the JVM but NFKC and case folding, which Spark
lacks; both are Arrow UDFs that leave ASCII batches untouched.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A number not preceded by a word character, and the tokens.
NUMBER = r"(?<!\w)[+-]?(?:\d+/\d+|\d+(?:,\d{3})*(?:\.\d+)?)"
TOKEN = "([a-z0-9]+|<num>)"

# Words that hint at an operation, and operations' categories.
CUES = {
    "addition": ["altogether", "combined", "sum", "total"],
    "division": ["equally", "per", "share", "shared"],
    "multiplication": ["each", "every", "groups", "times"],
    "rate": ["average", "percent", "percentage", "rate", "ratio", "speed"],
    "subtraction": ["difference", "fewer", "left", "less", "remain", "remaining"],
}
CATEGORIES = {
    "+": "addition", "add": "addition", "-": "subtraction", "subtract": "subtraction", "*": "multiplication", "multiply": "multiplication",
    "/": "division", "divide": "division", "inverse": "division", "percent": "rate", "speed": "rate", "speed_in_still_water": "rate", "stream_speed": "rate",
}


def _is_ascii(text: pa.Array) -> bool:
    return pc.all(pc.string_is_ascii(text)).as_py() is not False


@F.arrow_udf(T.StringType())
def nfkc(text: pa.Array) -> pa.Array:
    if _is_ascii(text):
        return text
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


#: So marked, the optimizer evaluates it once and doesn't copy it, and the
#: regular expressions above it, into every use and pushed-down filter.
nfkc = nfkc.asNondeterministic()


@F.arrow_udf(T.StringType())
def casefold(text: pa.Array) -> pa.Array:
    if _is_ascii(text):
        return pc.ascii_lower(text)
    return pa.array([None if t is None else t.casefold() for t in text.to_pylist()], pa.string())


def tokens(text: Column, mask: bool = False, normalise: bool = True) -> Column:
    """Tokens of the words form: array of string; null for null."""
    low = F.lower(nfkc(text) if normalise else text)
    if mask:
        low = F.regexp_replace(low, NUMBER, " <num> ")
    return F.regexp_extract_all(low, F.lit(TOKEN), F.lit(1))


def words_form(text: Column, mask: bool = False, normalise: bool = True) -> Column:
    return F.array_join(tokens(text, mask, normalise), " ")


def spaces_form(text: Column, strip: bool = False) -> Column:
    out = F.regexp_replace(nfkc(text), r"(?U)\s+", " ")
    return F.trim(out) if strip else out


def folded_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(casefold(text), r"(?U)\s+", " "))


def lower_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


# Quoted spans (over lines too) and numbers of the structural signature.
QUOTED = "`[^`]*`|\"[^\"]*\"|'[^']*'"
SIGNED_NUMBER = r"(?U)(?<![\w.])[+-]?\d+(?:\.\d+)?%?"


def signature_form(text: Column) -> Column:
    quoted = F.regexp_replace(casefold(text), QUOTED, "<quoted>")
    return F.trim(F.regexp_replace(F.regexp_replace(quoted, SIGNED_NUMBER, "<number>"), r"(?U)\s+", " "))


def identity(text: Column, **kind) -> Column:
    """SHA-256 of the words form; ``mask=True`` is the number-neutral identity."""
    return F.sha2(words_form(text, **kind), 256)


def structural_signature(text: Column) -> Column:
    return F.sha2(signature_form(text), 256)


def _runs(words: Column, size: int) -> Column:
    """All runs of ``size`` words, by zipping the array with itself moved on:
    the lambda sees its own struct only, so work is in proportion to the words."""
    n = F.greatest(F.size(words) - size + 1, F.lit(0))
    moved = F.arrays_zip(*[F.slice(words, F.lit(k + 1), n).alias(f"w{k}") for k in range(size)])
    return F.transform(moved, lambda z: F.concat_ws(" ", *[z[f"w{k}"] for k in range(size)]))


def ngrams(words: Column, size: int) -> Column:
    """Distinct n-grams; shorter texts are one gram of all words, none if empty."""
    n, many = F.size(words), _runs(words, size)
    return F.when(n == 0, F.array().cast("array<string>")).when(n < size, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(many))


def windows(words: Column, size: int) -> Column:
    """Distinct windows of ``size`` words; shorter texts have none."""
    return F.array_distinct(_runs(words, size))


def selection_ngrams(words: Column, size: int = 5) -> Column:
    """As ``ngrams``, but an empty text has one empty gram."""
    return F.when(F.size(words) == 0, F.array(F.lit(""))).otherwise(ngrams(words, size))


def jaccard(left: Column, right: Column) -> Column:
    """Of two distinct arrays; two empty ones are equal."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when(union == 0, 1.0).otherwise(shared / union)


def prefix_echo(response: Column, question: Column) -> Column:
    """The response begins with the question's first min(8, n) words, for at
    least 5; a shorter response does not."""
    n = F.least(F.lit(8), F.size(question))
    return (n >= 5) & (F.slice(response, F.lit(1), F.greatest(n, F.lit(0))) == F.slice(question, F.lit(1), F.greatest(n, F.lit(0))))


def word_overlap(left: Column, right: Column) -> Column:
    """Jaccard of the word sets; 0 where either side has no word."""
    return F.when((F.size(left) > 0) & (F.size(right) > 0), jaccard(F.array_distinct(left), F.array_distinct(right))).otherwise(0.0)


def restates(question: Column, completion: Column, size: int = 8) -> Column:
    """Some window of the completion lies in the question."""
    return F.coalesce(F.arrays_overlap(windows(question, size), windows(completion, size)), F.lit(False))


def repeats(words: Column) -> Column:
    """A word twice in a row, or, of nine words or more, any three three times."""
    n = F.size(words)
    moved = lambda array, k: F.slice(array, F.lit(k + 1), F.greatest(F.size(array) - k, F.lit(0)))
    same = lambda array, k: F.exists(F.arrays_zip(F.slice(array, F.lit(1), F.greatest(F.size(array) - k, F.lit(0))).alias("x"), moved(array, k).alias("y")), lambda z: z["x"] == z["y"])
    return (n > 1) & (same(words, 1) | ((n >= 9) & same(F.array_sort(_runs(words, 3)), 2)))


def repeated_phrase(words: Column, widths: range = range(2, 6)) -> Column:
    """A phrase of some width directly followed by itself."""
    def of(width: int) -> Column:
        runs = _runs(words, width)
        n = F.greatest(F.size(runs) - width, F.lit(0))
        return F.exists(F.arrays_zip(F.slice(runs, F.lit(1), n).alias("x"), F.slice(runs, F.lit(width + 1), n).alias("y")), lambda z: z["x"] == z["y"])

    found = F.lit(False)
    for width in widths:
        found = found | of(width)
    return found


def operation_cues(words: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, lex))), F.lit(name)) for name, lex in sorted(CUES.items())]))


def formula_categories(operations: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(operations, lambda o: F.try_element_at(table, o)))))


def url_fingerprint(url: Column) -> Column:
    """Words form of host and path, numbers masked."""
    path = F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "^/+|/+$", "")
    return words_form(F.concat_ws(" ", F.try_parse_url(url, F.lit("HOST")), path), mask=True, normalise=False)


def prompt_echo(prompt: Column, response: Column, least: int = 24) -> Column:
    p, r = lower_form(prompt), lower_form(response)
    return (F.length(p) >= least) & F.contains(r, p)


def bucket(value: Column, uppers: list[int], labels: list[str]) -> Column:
    """The label of the first upper bound that isn't exceeded; the last label beyond."""
    out = F.when(value <= uppers[0], labels[0])
    for u, name in zip(uppers[1:], labels[1:]):
        out = out.when(value <= u, name)
    return out.otherwise(labels[-1])


# Bucket bounds and names.
def question_bucket(n: Column) -> Column:
    return bucket(n, [32, 64, 96], ["1_to_32", "33_to_64", "65_to_96", "97_plus"])


def count_bucket(n: Column) -> Column:
    return bucket(n, [0, 1, 2], ["0", "1", "2", "3_plus"])


def magnitude_bucket(value: Column) -> Column:
    m = F.abs(value)
    return F.when(m == 0, "zero").when(m < 1, "below_1").when(m < 10, "1_to_9").when(m < 100, "10_to_99").when(m < 1000, "100_to_999").otherwise("1000_plus")


def seed_of(*parts: Column) -> Column:
    """The first 16 hex digits of SHA-256 of the parts joined by ':' as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def seeded_rank(seed: str, key: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string")), 256)


# What a content-free record may not hold.
CONTENT_FIELDS = ["prompt", "question", "response", "completion", "answer", "canonical_answer", "expected", "text", "raw_response", "reference", "messages"]


def content_free(schema: T.DataType, column: Column, forbidden: list[str] | None = None) -> Column:
    """The column without fields that hold content, however deeply they lie."""
    names = forbidden or CONTENT_FIELDS
    if isinstance(schema, T.StructType):
        kept = [f for f in schema.fields if f.name not in names]
        whole = F.struct(*[content_free(f.dataType, column.getField(f.name), names).alias(f.name) for f in kept])
        return F.when(column.isNotNull(), whole)
    if isinstance(schema, T.ArrayType) and isinstance(schema.elementType, (T.StructType, T.ArrayType)):
        return F.transform(column, lambda x: content_free(schema.elementType, x, names))
    return column


def structure_hash(neutral_id: Column, cues: Column) -> Column:
    """Digest of the canonical JSON of a number-neutral identity and its cues."""
    listed = F.array_join(F.transform(cues, lambda c: F.concat(F.lit('"'), c, F.lit('"'))), ",")
    return F.sha2(F.concat(F.lit('{"number_neutral_sha256":"'), neutral_id, F.lit('","operation_cues":['), listed, F.lit("]}")), 256)


def serialized(numerator: Column, denominator: Column) -> Column:
    """'n' or 'n/d'."""
    n, d = numerator.cast("string"), denominator.cast("string")
    return F.when(denominator == 1, n).otherwise(F.concat(n, F.lit("/"), d))


def messages(question: Column, system: str, before: str = "", after: str = "", completion: Column | None = None) -> Column:
    """array of (role, content): the system's, the user's and, with a completion,
    the assistant's; a blank question or completion is an error."""
    blank = lambda c: F.coalesce(~F.rlike(c, F.lit(r"(?U)\S")), F.lit(True))
    of = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    turns = [of("system", F.lit(system)), of("user", F.concat(F.lit(before), question, F.lit(after)))]
    bad = blank(question)
    if completion is not None:
        turns.append(of("assistant", completion))
        bad = bad | blank(completion)
    return F.when(bad, F.raise_error(F.lit("question and completion have to hold text"))).otherwise(F.array(*turns))


def built_completion(formula: Column, operations: Column, answer: Column) -> Column:
    """The calculation, in short where it is long, and the final answer's line."""
    short = (operations <= 6) & (F.length(formula) <= 120)
    said = F.when(short, F.concat(F.lit("Calculation: "), formula)).otherwise(F.concat(F.lit("Calculation: "), operations.cast("string"), F.lit(" operations evaluate to "), answer, F.lit(".")))
    return F.concat(said, F.lit("\nFinal answer: "), answer)
