"""String functions of the pipeline as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Common words that carry no topic, the 331 distinct ones of the reference's list.
STOP_WORDS = (
    "a about above across after afterwards again against all almost alone along already also although always am among amongst amoungst amount an "
    "and another any anyhow anyone anything anyway anywhere are around as at back be became because become becomes becoming been before "
    "beforehand behind being below beside besides best between beyond both bottom but by call can cannot cant co con could couldnt cry de "
    "describe detail did do done dont down due during each eg eight either eleven else elsewhere empty end enough etc even ever every everyone "
    "everything everywhere except few fifteen fify fill find fire first five for former formerly forty found four from front full further get "
    "give go had has hasnt have he hence her here hereafter hereby herein hereupon hers herself him himself his how however hundred i ie if in "
    "inc including indeed interest into is it its itself just keep known last later latter latterly least less ltd made many may me meanwhile "
    "might mill mine more moreover most mostly move much must my myself name namely neither never nevertheless new next nine no nobody none "
    "noone nor not nothing now nowhere of off often on once one only onto or other others otherwise our ours ourselves out over own part per "
    "perhaps please put rather re same see seem seemed seeming seems serious several she should show side since sincere six sixty so some "
    "somehow someone something sometime sometimes somewhere st still such system take ten than that the their them themselves then thence there "
    "thereafter thereby therefore therein thereupon these they thick thin third this those though three through throughout thru thus to together "
    "too top toward towards twelve twenty two un under until up upon us used using very via was we well were what whatever when whence whenever "
    "where whereafter whereas whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why will with within "
    "without would year years yet you your yours yourself yourselves"
).split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used.

    Inside a higher-order function an expression of the row would be computed again for
    every element; a lambda's variable is not.
    """
    return F.get(F.transform(F.array(value), use), 0)


def chars(x: Column) -> Column:
    """Characters of a string, none for the empty one."""
    return F.filter(F.split(x, ""), lambda c: c != "")


def title_case(x: Column) -> Column:
    """Every letter after a non-letter in upper case, every other one in lower case."""

    def cased(cs: Column) -> Column:
        return F.transform(cs, lambda c, i: F.when((i == 0) | ~F.get(cs, i - 1).rlike(r"\p{L}"), F.upper(c)).otherwise(F.lower(c)))

    return F.array_join(let(F.split(x, ""), cased), "")


def cap_words(x: Column) -> Column:
    """Words separated by white space, each with a capital, joined by single spaces."""
    return F.initcap(F.regexp_replace(strip(x), r"\s+", " "))


def first_upper(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))


def alnum_words(x: Column) -> Column:
    """Runs of ASCII letters and digits."""
    return F.regexp_extract_all(x, F.lit("[A-Za-z0-9]+"), F.lit(0))


def cap_phrase(x: Column) -> Column:
    """A phrase all in capitals as capitalised words; any other as it is."""
    words = F.transform(alnum_words(x), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
    return F.when(x == F.upper(x), F.array_join(words, " ")).otherwise(x)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def split_nonempty(x: Column, separators: str) -> Column:
    """Fields between any of the separator characters, without empty ones."""
    return F.filter(F.split(x, f"[{separators}]"), lambda t: t != "")


def tokens(x: Column) -> Column:
    """Runs of letters and digits of any script, and every other visible character by
    itself."""
    return F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))


#: Tokens and the white space between them: nothing of a text is left out.
PIECES = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]|\s+"


def plain_quotes(token: Column) -> Column:
    """Typographic and doubled quotes as a plain double quote."""
    return F.when(token.isin("``", "''", "“", "”", "„", "«", "»"), '"').otherwise(token)


def token_places(tokens: Column, body: Column) -> Column:
    """Where each token begins in its text, from 0, looked for behind the one before it; a
    quote is found in any of its spellings, and a token that is not there has -1."""
    quote = r"``|''|[\"“”„«»]"

    def step(acc: Column, t: Column) -> Column:
        rest = F.substr(body, acc["at"] + 1)
        plain = F.instr(rest, t)
        quoted = F.regexp_instr(rest, F.lit(quote))
        found = F.when(t.rlike(f"^(?:{quote})$"), quoted).otherwise(plain)
        size = F.when(t.rlike(f"^(?:{quote})$"), F.length(F.regexp_extract(rest, quote, 0))).otherwise(F.length(t))
        here = F.when(found > 0, acc["at"] + found - 1).otherwise(-1)
        return F.struct(F.when(found > 0, acc["at"] + found - 1 + size).otherwise(acc["at"]).cast("int").alias("at"), F.concat(acc["out"], F.array(here.cast("int"))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(tokens, start, step, lambda a: a["out"])


def alnum_only(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{L}\p{N}]", "")


def unescaped(x: Column) -> Column:
    """Without HTML entities, underscores and no-break spaces."""
    x = F.replace(F.replace(x, F.lit("&amp;"), F.lit("&")), F.lit("&quot;"), F.lit('"'))
    return F.translate(x, "_ ", "  ")


def field_escaped(x: Column) -> Column:
    """A field of a tab-separated line: backslash, tab and line breaks by a backslash."""
    for plain, written in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        x = F.replace(x, F.lit(plain), F.lit(written))
    return x


def field_unescaped(x: Column) -> Column:
    """What ``field_escaped`` was made from."""

    def part(p: Column) -> Column:
        for plain, written in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            p = F.replace(p, F.lit(written), F.lit(plain))
        return p

    # Between doubled backslashes all others begin an escape.
    return F.array_join(F.transform(F.split(x, r"\\\\"), part), "\\")


def uri_title(uri: Column) -> Column:
    """The name in the last step of a link or path, percent-decoded, as an entity title."""
    step = F.regexp_extract(uri, r"([^/]*)$", 1)
    return entity_title(F.coalesce(percent_decoded(step), step))


def entity_title(x: Column) -> Column:
    """A link target as an entity name: unescaped, trimmed, with a first capital."""
    return first_upper(strip(unescaped(x)))


def percent_decoded(x: Column) -> Column:
    """URL escapes resolved; a plus stays a plus, an invalid escape gives null."""
    return F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))


def unicode_unescaped(x: Column) -> Column:
    """``\\uXXXX`` escapes resolved; null where the text isn't valid inside quotes."""
    return F.get(F.from_json(F.concat(F.lit('["'), x, F.lit('"]')), "array<string>"), 0)


def at_word_boundary(text: Column, part: Column) -> Column:
    """Whether ``part`` is in ``text`` with no letter directly before or after it, and is
    shorter."""
    def holds(padded: Column) -> Column:
        def at(i: Column) -> Column:
            return (F.substr(padded, i + 1, F.length(part)) == part) & ~F.substr(padded, i, F.lit(1)).rlike(r"\p{L}") & ~F.substr(padded, i + 1 + F.length(part), F.lit(1)).rlike(r"\p{L}")

        return F.exists(F.sequence(F.lit(1), F.greatest(F.length(padded) - F.length(part) - 1, F.lit(1))), at)

    return (F.length(text) > F.length(part)) & F.contains(text, part) & let(F.concat(F.lit(" "), text, F.lit(" ")), holds)


def clamped_log(p: Column, zero: float = 1e-6) -> Column:
    return F.ln(F.least(F.lit(1.0), F.greatest(F.lit(zero), p)))


def bucket(x: Column, bounds: list[float]) -> Column:
    """How many of the ascending bounds are at or below ``x``."""
    out = F.lit(0)
    for b in bounds:
        out = out + (x >= b).cast("int")
    return out


def is_content_word(word: Column) -> Column:
    """Longer than one character, no number, no stop word."""
    return (F.length(word) > 1) & word.try_cast("double").isNull() & ~F.lower(word).isin(*STOP_WORDS)
