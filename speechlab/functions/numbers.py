"""Symbols and numbers of a text as words, as column expressions and as a table of distinct numeric tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of numbers below twenty, of tens, of groups of three digits, and irregular ordinals.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "_ ten twenty thirty forty fifty sixty seventy eighty ninety".split()
GROUPS = ["", " thousand", " million", " billion", " trillion", " quadrillion", " quintillion", " sextillion", " septillion", " octillion", " nonillion", " decillion"]
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
# One-character currency symbols and their names.
CURRENCIES = {
    "$": "dollar", "؋": "afghani", "ƒ": "guilder", "₼": "manat", "P": "pula", "៛": "riel", "¥": "yen", "₡": "colon", "₱": "peso", "£": "pound",
    "€": "euro", "₾": "lari", "¢": "cedis", "Q": "quetzal", "L": "lempira", "₹": "rupee", "﷼": "rial", "₪": "shekel", "₩": "won", "₭": "kip",
    "₨": "rupee", "₮": "tughrik", "₦": "naira", "₽": "ruble", "S": "shilling", "R": "rand", "฿": "baht", "₺": "lira", "₴": "hryvna", "₫": "dong",
}

# characters that no text holds: before a unit, for a one that has been looked at, and for the unit cent
_UNIT, _ONE, _CENT = "\u0001", "\u0002", "\u0003"


def _amounts(text: Column, amount: str, group: int, number: int) -> Column:
    """Amounts written as ``amount`` with the symbol in ``group``: units and cents, marked, in singular where they are 1.

    number: the first group of what is put into ``amount``.
    """
    unit, n, m = f"{_UNIT}${group}s", f"${number}", f"${number + 1}"
    cents = f"{_UNIT}{_CENT}s"
    out = F.regexp_replace(text, amount.format(r"([0-9]*\.[0-9]*\.[0-9.]*[0-9])"), f"{n} {unit}")  # more than two parts stay
    two = r"0*([1-9][0-9]*)\.0*([1-9][0-9]*)"
    if group < number:
        out = F.regexp_replace(out, amount.format(two), f"{n} {unit} and {m} {cents}")
    else:
        out = F.regexp_replace(out, amount.format(two), f"{n} {_UNIT}$3s and $2 {cents}")
        unit = f"{_UNIT}$2s"
    out = F.regexp_replace(out, amount.format(r"0*([1-9][0-9]*)(?:\.0+)?"), f"{n} {unit}")
    out = F.regexp_replace(out, amount.format(r"0*\.0*([1-9][0-9]*)"), f"{n} {cents}")
    return F.regexp_replace(out, amount.format(r"(0+)(?:\.0+)?"), f"zero {unit}")


def _in_turn(x: Column, steps: list) -> Column:
    """``x`` through steps ``(test, work)``: those whose test it meets. Each value is worked out once, however often a step names it."""
    if not steps:
        return x
    (test, work), *rest = steps
    return _in_turn(F.get(F.transform(F.array(x), lambda v: F.when(test(v), work(v)).otherwise(v)), F.lit(0)), rest)


def expand_symbols(text: Column, currencies: dict[str, str] | None = None) -> Column:
    """Thousands separators removed, then percent signs and currency symbols on either side of a number, then decimal points.

    ``$2.50`` is two dollars and fifty cents, an amount of nothing is zero of its unit, and a number of more than
    two dotted parts is kept before its unit. Percent signs and symbols without a number stay. Dollars come first, then all
    other symbols together: before a number, then after it. No rule reaches over a blank, so only words with a digit are
    worked on, and by the rules whose symbol they hold.
    """
    known = CURRENCIES if currencies is None else currencies
    thousands = lambda v: F.regexp_replace(v, "([0-9]),+([0-9])", "$1$2")
    # a digit between two separators belongs to both matches
    steps: list = [(lambda v: v.contains(","), lambda v: thousands(thousands(v)))]
    steps.append((lambda v: v.contains("%"), lambda v: F.regexp_replace(F.regexp_replace(v, "%([0-9]+)", "$1 percent"), "([0-9]+)%", "$1 percent")))
    others = [s for s in known if s != "$"]
    for symbols in (["$"] if "$" in known else [], others):
        if not symbols:
            continue
        kind = "([" + "".join(f"\\Q{s}\\E" for s in symbols) + "])"
        steps.append((lambda v, kind=kind: v.rlike(f"{kind}[.0-9]"), lambda v, kind=kind: _amounts(v, kind + "{0}", 1, 2)))
        steps.append((lambda v, kind=kind: v.rlike(f"[0-9]{kind}"), lambda v, kind=kind: _amounts(v, "{0}" + kind, 2, 1)))

        def named(told: Column, symbols: list[str] = symbols) -> Column:
            told = F.regexp_replace(told, f"(^|[^0-9])1 {_UNIT}(.)s", f"$1{_ONE} {_UNIT}$2")
            told = F.translate(told, _ONE, "1")
            for s in symbols:
                told = F.replace(told, F.lit(_UNIT + s), F.lit(known[s]))
            return F.replace(told, F.lit(_UNIT + _CENT), F.lit("cent"))

        steps.append((lambda v: v.contains(_UNIT), named))
    steps.append((lambda v: v.contains("."), lambda v: F.regexp_replace(v, r"([0-9]+)\.([0-9]+)", "$1 point $2")))
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.when(w.rlike("[0-9]"), _in_turn(w, steps)).otherwise(w)), " ")


def below_thousand(n: Column, joint: str = " ") -> Column:
    """Words of 1 to 999; ``joint`` comes between hundreds and the rest. Empty for 0."""
    ones, tens = F.array(*map(F.lit, ONES)), F.array(*map(F.lit, TENS))
    rest = (n % 100).cast("int")
    small = F.when(rest < 20, F.get(ones, rest)).when(rest % 10 == 0, F.get(tens, (rest / 10).cast("int")))
    small = small.otherwise(F.concat_ws("-", F.get(tens, F.floor(rest / 10).cast("int")), F.get(ones, rest % 10)))
    hundred = F.when(n >= 100, F.concat(F.get(ones, F.floor(n / 100).cast("int")), F.lit(" hundred")))
    return F.concat_ws(joint, hundred, F.when((rest > 0), small))


def cardinal(digits: Column, joint: str = " ", last: str = " ") -> Column:
    """Words of a run of digits, three by three with the group's name, groups apart by commas; null beyond ``GROUPS`` (36 digits).

    ``last`` comes before a last group below 100 that follows another one.
    """
    bare = F.regexp_replace(digits, "^0+", "")
    n = F.floor((F.length(bare) + 2) / 3).cast("int")
    padded = F.concat(F.repeat(F.lit("0"), n * 3 - F.length(bare)), bare)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.struct((n - k).alias("left"), F.coalesce(F.substring(padded, k * 3 - 2, F.lit(3)).try_cast("int"), F.lit(0)).alias("value")))
    groups = F.filter(cut, lambda g: g["value"] > 0)
    names = F.array(*map(F.lit, GROUPS))
    told = F.transform(groups, lambda g: F.concat(below_thousand(g["value"], joint), F.get(names, g["left"])))
    end = F.element_at(groups, -1)
    short = (F.size(told) > 1) & (end["left"] == 0) & (end["value"] < 100)
    words = F.when(short, F.concat(F.array_join(F.slice(told, F.lit(1), F.greatest(F.size(told) - 1, F.lit(1))), ", "), F.lit(last), F.element_at(told, -1)))
    return F.when(bare == "", "zero").when(n <= len(GROUPS), words.otherwise(F.array_join(told, ", ")))


def number_words(n: Column, joint: str = " ") -> Column:
    """Words of a whole number that is not negative; null for null."""
    return cardinal(n.cast("string"), joint, joint)


def year_words(n: Column) -> Column:
    """Words of numbers between 1000 and 3000 read as years: in pairs, 0 as oh; 2001 to 2009 and whole hundreds as such."""
    high, low = F.floor(n / 100), n % 100
    pair = F.when(low < 10, F.concat(F.lit("oh "), below_thousand(low))).otherwise(below_thousand(low))
    return (
        F.when(n == 2000, "two thousand")
        .when((n > 2000) & (n < 2010), F.concat(F.lit("two thousand "), below_thousand(low)))
        .when(low == 0, F.concat(below_thousand(high), F.lit(" hundred")))
        .otherwise(F.concat_ws(" ", below_thousand(high), pair))
    )


def ordinal_words(cardinal: Column) -> Column:
    """The ordinal of a cardinal in words: its last word is changed."""
    last = F.regexp_extract(cardinal, "[a-z]+$", 0)
    head = F.substring(cardinal, F.lit(1), F.length(cardinal) - F.length(last))
    irregular = F.create_map(*[F.lit(x) for pair in ORDINALS.items() for x in pair])
    regular = F.when(last.endswith("y"), F.concat(F.regexp_replace(last, "y$", ""), F.lit("ieth"))).otherwise(F.concat(last, F.lit("th")))
    return F.concat(head, F.coalesce(F.try_element_at(irregular, last), regular))


def spoken(digits: Column, ordinal: Column) -> Column:
    """Words of a run of digits: years between 1000 and 3000, else cardinals; ordinals say ``and`` after hundreds.

    Numbers beyond the named groups (36 digits) are null.
    """
    bare = F.regexp_replace(digits, "^0+", "")
    n = F.when(F.length(bare) <= 4, bare.try_cast("bigint"))
    plain = F.when((n > 1000) & (n < 3000), year_words(n)).otherwise(cardinal(digits))
    return F.when(ordinal, ordinal_words(cardinal(digits, " and ", " and "))).otherwise(plain)


def number_table(tokens: DataFrame, token: str = "token") -> DataFrame:
    """``token, words``: each distinct token that holds a digit, with its symbols expanded and its numbers in words.

    Numbers are cut out of the distinct expanded tokens, told once for each distinct run of digits, and joined
    back, so that the work follows the distinct numbers and not the text. A number without words stays as its digits.
    """
    distinct = tokens.where(F.col(token).rlike("[0-9]")).select(F.col(token).alias("token")).distinct()
    parts = F.expr("regexp_extract_all(__x, '[0-9]+(?:st|nd|rd|th)?|[^0-9]+', 0)")
    cut = distinct.withColumn("__x", expand_symbols(F.col("token"))).select("token", F.posexplode(parts).alias("i", "part"))
    runs = cut.where(F.col("part").rlike("^[0-9]")).select("part").distinct()
    told = runs.select("part", spoken(F.regexp_extract("part", "^[0-9]+", 0), F.col("part").rlike("[a-z]$")).alias("told"))
    whole = cut.join(told, "part", "left").groupBy("token").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("told", "part").alias("p")))).alias("ps"))
    return whole.select("token", F.array_join(F.transform("ps", lambda x: x["p"]), "").alias("words"))
