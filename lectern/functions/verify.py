"""Guards: does a rewrite keep values, negations, direction and content of its source? Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .combinators import counts, let, only, words_of
from .numbers import number_to_words

# Word classes.
NEGATIONS = ["not", "no", "never", "none", "neither", "nor", "cannot", "without", "nothing", "nobody", "hardly", "scarcely", "barely", "non"]
SCOPE = ["only", "all", "every", "each", "both", "more", "less", "fewer", "most", "least", "any", "some", "few", "many", "much"]
UP = [
    "increased", "increase", "increases", "increasing", "rose", "rise", "rises", "risen", "higher", "highest", "greater", "greatest", "positive",
    "positively", "faster", "doubled", "tripled", "quadrupled", "exceeded", "exceed", "gained", "gain", "upregulated",
]
DOWN = [
    "decreased", "decrease", "decreases", "decreasing", "fell", "fall", "falls", "fallen", "lower", "lowest", "lesser", "negative", "negatively",
    "slower", "halved", "lost", "loss", "downregulated",
]
DIRECTION = [*UP, *DOWN, "above", "below", "under", "before", "after"]
FUNCTION = [
    "a", "an", "the", "and", "or", "but", "yet", "so", "for", "of", "in", "on", "at", "to", "by", "with", "from", "into", "onto", "upon", "between",
    "among", "through", "during", "as", "than", "then", "thus", "it", "its", "this", "that", "these", "those", "they", "them", "their", "we", "our",
    "us", "he", "she", "his", "her", "him", "i", "you", "your", "which", "who", "whom", "whose", "there", "here", "is", "are", "was", "were", "be",
    "been", "being", "am", "has", "have", "had", "do", "does", "did", "will", "would", "shall", "should", "can", "could", "may", "might", "must",
    "if", "while", "when", "where", "because", "since", "although", "though",
]
NUMBERS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen",
    "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred",
    "thousand", "million", "billion", "trillion", "point", "minus", "plus", "half", "first", "second", "third", "fourth", "fifth", "sixth",
    "seventh", "eighth", "ninth", "tenth", "hundreds", "thousands", "millions", "billions", "dozen", "dozens", "fold", "decade", "decades",
    "quarter", "quarters", "thirds",
]
UNIT_WORDS = [
    "millimeters", "millimeter", "centimeters", "centimeter", "meters", "meter", "kilometers", "micrometers", "micrometer", "nanometers",
    "nanometer", "angstrom", "angstroms", "molar", "millimolar", "micromolar", "moles", "micromoles", "millimoles", "nanomoles", "grams",
    "kilograms", "milligrams", "micrograms", "nanograms", "kilogram", "milligram", "pascals", "pascal", "kilopascals", "megapascals", "gigapascals",
    "bars", "millibars", "volts", "millivolts", "microvolts", "kilovolts", "ohms", "amperes", "milliamperes", "watts", "milliwatts", "kilowatts",
    "joules", "kilojoules", "newtons", "kelvin", "celsius", "fahrenheit", "degrees", "percent", "hertz", "kilohertz", "megahertz", "gigahertz",
    "liters", "milliliters", "microliters", "radians", "siemens", "tesla", "micromole", "millimole",
]
CONNECTIVES = ["per", "times", "over", "divided", "squared", "cubed"]
NOTATION = [
    "alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omicron", "pi", "rho",
    "sigma", "tau", "upsilon", "phi", "chi", "psi", "omega",
]
VALUES = [*NUMBERS, *UNIT_WORDS, *CONNECTIVES, *NOTATION]
MAX_SPAN, MIN_NEW, MAX_NEW = 200, 5, 0.6
VIOLATIONS = "array<struct<kind:string,detail:string>>"


def digits(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\d"), F.lit(0))


def value_words(text: Column) -> Column:
    return only(words_of(text), VALUES)


def _with_contractions(text: Column, allowed: list[str]) -> Column:
    short = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+n't"), F.lit(0)), lambda _: F.lit("n't"))
    return F.concat(only(words_of(text), allowed), short)


def polarity_counts(text: Column) -> Column:
    return counts(_with_contractions(text, NEGATIONS + SCOPE))


def negations(text: Column) -> Column:
    return counts(_with_contractions(text, NEGATIONS))


def direction_counts(text: Column) -> Column:
    return counts(only(words_of(text), DIRECTION))


def content_words(text: Column) -> Column:
    """Words of no closed class, in order."""
    closed = sorted({*FUNCTION, *NEGATIONS, *SCOPE, *VALUES, *DIRECTION})
    return F.filter(words_of(text), lambda w: ~w.isin(closed))


def _same(a: Column, b: Column) -> Column:
    return F.map_entries(a) == F.map_entries(b)


def _beyond(a: Column, b: Column) -> Column:
    """How many words of a are not matched in b, as multisets."""
    of = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.greatest(of(a, w) - of(b, w), F.lit(0)))


def copyedit_guard(find: Column, replace: Column) -> Column:
    """An edit that can't change meaning: spaces only, or one content word for another with all else kept."""
    before, after = content_words(find), content_words(replace)
    spaces = F.regexp_replace(find, r"\s+", "") == F.regexp_replace(replace, r"\s+", "")
    lost, new = _beyond(before, after), _beyond(after, before)
    kept = (digits(find) == digits(replace)) & (value_words(find) == value_words(replace)) & _same(polarity_counts(find), polarity_counts(replace)) & _same(direction_counts(find), direction_counts(replace))
    return (F.trim(find) != "") & (find != replace) & (F.length(find) <= MAX_SPAN) & (spaces | (kept & (lost == new) & (new <= 1)))


def speakable_violations(spoken: Column) -> Column:
    bad = F.array_sort(F.array_distinct(F.regexp_extract_all(spoken, F.lit(r"""[^A-Za-z \t\n.,;:!?'"()\-–—‘’“”…]"""), F.lit(0))))
    shown = F.array_join(F.transform(F.slice(bad, 1, 12), lambda c: F.concat(F.lit("'"), c, F.lit("'"))), " ")
    detail = F.concat(F.lit("non-speakable characters in spoken text: "), shown)
    return F.when(F.size(bad) > 0, F.array(_violation("speakable", detail))).otherwise(_none())


def _violation(kind: str, detail: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))


def _none() -> Column:
    return F.array().cast(VIOLATIONS)


def fold(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.replace(text, F.lit("-"), F.lit(" "))), r"\s+", " "))


def source_values(source: Column) -> Column:
    """Decimals and whole percentages in order, but for cross-references and lone numbers in parentheses."""
    number = r"(?<![\w.])-?\d[\d,]*\.\d+|(?<![\w.])-?\d[\d,]*(?=\s*%)"
    pointer = r"(?i)\b(?:figs?|figures?|eqn?|eqs|equations?|tables?|sections?|sec|chapters?|appendix|appendices|refs?|panels?)\.?\s{0,9}\(?\s{0,9}"
    # the longest alternative first: a pointer or a parenthesis takes its number along, and is dropped
    found = F.regexp_extract_all(source, F.lit(rf"{pointer}-?\d[\d,]*\.\d+|\(-?\d[\d,]*\.\d+\)|{number}"), F.lit(0))
    return F.filter(found, lambda m: m.rlike(r"^-?\d"))


def value_violations(source: Column, spoken: Column) -> Column:
    """Each source value, in words, must come up in the spoken text, in order."""
    body = F.regexp_replace(fold(spoken), r"\bnegative\b", "minus")
    wanted = F.transform(source_values(source), lambda t: F.struct(t.alias("token"), fold(number_to_words(t)).alias("words")))

    def check(text: Column) -> Column:
        padded = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\w']+", " "), F.lit(" "))
        start = F.struct(F.lit(0).alias("at"), _none().alias("found"))

        def step(a: Column, v: Column) -> Column:
            phrase = F.concat(F.lit(" "), v["words"], F.lit(" "))
            rest = F.substring(padded, a["at"] + 1, F.length(padded))
            here, any_ = F.instr(rest, phrase), F.instr(padded, phrase)
            named = F.concat(F.lit("value '"), v["token"], F.lit("' ('"), v["words"], F.lit("') "))
            problem = _violation("values", F.concat(named, F.when(any_ == 0, "missing from spoken").otherwise("out of order")))
            return F.struct(
                F.when(here > 0, a["at"] + here + F.length(v["words"])).otherwise(a["at"]).cast("int").alias("at"),
                F.when(here > 0, a["found"]).otherwise(F.concat(a["found"], F.array(problem))).alias("found"),
            )

        return F.aggregate(wanted, start, step, lambda a: a["found"])

    return let(body, check)


def count_violations(source: Column, spoken: Column) -> Column:
    """Negations exactly kept, scope words not dropped, direction neither flipped nor lost."""
    total = lambda text, allowed: F.size(only(words_of(text), allowed))
    show = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(": ", e["key"], e["value"])), ", ")
    before, after = negations(source), negations(spoken)
    flip = F.when(_same(before, after), _none()).otherwise(F.array(_violation("polarity", F.concat(F.lit("negation changed: {"), show(before), F.lit("} -> {"), show(after), F.lit("}")))))
    said = words_of(spoken)
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    dropped = F.filter(F.array_sort(F.array_distinct(only(words_of(source), SCOPE))), lambda w: times(said, w) < times(words_of(source), w))
    scope = F.when(F.size(dropped) > 0, F.array(_violation("polarity", F.concat(F.lit("scope word(s) dropped: "), F.array_join(dropped, ", "))))).otherwise(_none())
    su, sd, ku, kd = total(source, UP), total(source, DOWN), total(spoken, UP), total(spoken, DOWN)
    flipped = ((su > 0) & (sd == 0) & (kd > 0) & (ku == 0)) | ((sd > 0) & (su == 0) & (ku > 0) & (kd == 0))
    lost = (su + sd > 0) & (ku + kd == 0)
    what = F.concat(F.lit("direction "), F.when(flipped, "reversed").otherwise("lost"), F.lit(": source up/down "), F.concat_ws("/", su, sd), F.lit(" -> spoken "), F.concat_ws("/", ku, kd))
    return F.concat(flip, scope, F.when(flipped | lost, F.array(_violation("direction", what))).otherwise(_none()))


def paraphrase_violations(source: Column, spoken: Column) -> Column:
    old = F.array_distinct(content_words(source))
    new = F.array_sort(F.array_except(content_words(spoken), content_words(source)))
    over = (F.size(new) > MIN_NEW) & (F.size(new) > MAX_NEW * F.greatest(F.size(old), F.lit(1)))
    detail = F.concat(F.size(new).cast("string"), F.lit(" content words not in source: "), F.array_join(F.slice(new, 1, 8), ", "))
    return F.when(over, F.array(_violation("paraphrase", detail))).otherwise(_none())


def verify_segment(source: Column, spoken: Column, check_values: bool = True) -> Column:
    """struct(ok, violations)."""
    families = [speakable_violations(spoken), *([value_violations(source, spoken)] if check_values else []), count_violations(source, spoken), paraphrase_violations(source, spoken)]
    return let(F.concat(*families), lambda v: F.struct((F.size(v) == 0).alias("ok"), v.alias("violations")))
