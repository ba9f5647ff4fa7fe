"""Scalar functions on message text, as Column expressions.

Patterns are written for the JVM's regex engine: Unicode classes, possessive groups where a
group repeats, so that long runs neither overflow the stack nor back-track. Alternatives
that look far ahead stand behind a guard: where such a one has failed, it fails again until
its run of characters ends or a token has been found (``\\G``), so it is tried there only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and patterns that define the tokens.
PUNCT = r"""['“".?!,:;]"""
ENTITY = r"&(?:amp|lt|gt|quot);"
EDGE = r"""['"“”‘’<>«»{}()\[\]]"""
EMOTICON = r"(?:[:=]|;)(?:|o|O|-)(?:[pP]|[doO/\\]|[(\[]|[D)\]])"
HAPPY = r"\^_\^|[:=](?:|o|O|-)[D)\]]"
SAD = r"[:=](?:|o|O|-)[(\[]"
EMOTICON_KINDS = {
    "happy": HAPPY,
    "sad": SAD,
    "wink": r";(?:|o|O|-)[D)\]]",
    "tongue": r"[:=](?:|o|O|-)[pP]",
    "other": r"(?:[:=]|;)(?:|o|O|-)[doO/\\]",
}
URL = (
    r"\b(?:https?://|www\.|[a-z0-9.-]+?\.(?:com|co\.uk|org|net|info|ca)(?=[/ \W\x08]))"
    rf"[^ \t\r\n<>]*?(?=(?:(?:{PUNCT}|{ENTITY})+?)?(?:\.\.+|[<>]|\s|$))"
)
#: The same, tried once in a run of its characters: a match within a run is one from the run's first boundary too.
GUARDED_URL = URL.replace("[a-z0-9.-]+?", r"(?:(?<![a-z0-9.-])|\G|(?=[.-])|(?<=(?<![a-z0-9])-))[a-z0-9.-]+?", 1)
BOUNDARY_NOT_DOT = rf"""(?:\s|[“"?!,:;]|{ENTITY})"""
JUNK = r"^[^a-zA-Z0-9_@]+$"
PHRASE_BOUNDARY = r"""^(?:[.,“"'?!:;|-]+|&(?:amp|lt|gt|quot);)$"""
EDGE_TOKEN = rf"^{EDGE}+$"

#: Simple tokens.
SIMPLE = "[a-z0-9_@#']+"
_DIGITS = r"(?:(?<!\d)|\G)"
#: After a letter and a full stop a chain goes on, unless the letter ended an emoticon.
_CHAIN = r"(?:(?<![A-Za-z]\.)|(?<=[:=;][oO-]?[pPdDoO]\.))"
#: Spans that stay whole, the first that matches at a place wins.
PROTECTED = [
    EMOTICON,
    GUARDED_URL,
    ENTITY,
    rf"{_DIGITS}\d++:\d++",
    rf"{_DIGITS}\d++\.\d++",
    rf"{_DIGITS}\d++,(?:\d{{1,3}},)*+\d{{3}}(?=[^,]|$)",
    rf"{PUNCT}++",
    rf"{_CHAIN}(?:[A-Za-z]\.){{2,}}+(?={BOUNDARY_NOT_DOT})",
    rf"{_CHAIN}(?:[A-Za-z]\.)++[A-Za-z](?={BOUNDARY_NOT_DOT})",
    r"--+|―",
    r"[♫]+",
    r"(?:(?<!\S)|\G)\S[^\s']*+'\S++",
]
#: A run of whole words of letters and digits, which hold nothing to protect: passed over at once, to be padded as a whole.
PLAIN = r"(?<![^ ])[0-9\p{L}]++(?![^ ])(?: [0-9\p{L}]++(?![^ ]))*+"
PROTECT = "(?U)" + "|".join([PLAIN, *PROTECTED])


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(text: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(text), r"(?U) \s+|(?! )\s\s*+", " "))


def munge_edges(text: Column | str) -> Column:
    """A space between edge punctuation and the letter or digit that it touches, at either end of a run."""
    s = F.regexp_replace(_col(text), rf"(\s|^)({EDGE}+)([a-zA-Z0-9])", "$1$2 $3")
    return F.regexp_replace(s, rf"([a-zA-Z0-9])({EDGE}+)(\s|$)", "$1 $2$3")


def split_clitics(text: Column | str) -> Column:
    """``it's`` as ``it 's`` where a token ends."""
    return F.regexp_replace(_col(text), r"(\S)('s)(?= |$)", "$1 $2")


def tokenize(text: Column | str) -> Column:
    """Tokens of a message: protected spans are padded with spaces, then the text is split; null for null."""
    padded = F.regexp_replace(munge_edges(squeeze(text)), PROTECT, " $0 ")
    spaced = split_clitics(squeeze(padded))
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def simple_tokens(text: Column | str) -> Column:
    """Lower-case runs of letters, digits and ``_@#'``."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(SIMPLE), F.lit(0))


def has_simple(low: Column | str, token: str) -> Column:
    """Whether a text in lower case has a simple token, found without its other tokens."""
    rest = SIMPLE.removesuffix("+")
    return F.contains(_col(low), F.lit(token)) & F.rlike(_col(low), F.lit(rf"(?<!{rest})\Q{token}\E(?!{rest})"))


def lower_tokens(tokens: Column | str) -> Column:
    return F.transform(_col(tokens), lambda t: F.lower(t))


def norm_token(token: Column | str) -> Column:
    """A token without its leading junk, unless nothing is left."""
    t = _col(token)
    stripped = F.regexp_replace(t, "^[^a-zA-Z0-9_@]+", "")
    return F.when(F.length(stripped) >= 1, stripped).otherwise(t)


def sentiment(text: Column | str) -> Column:
    """BOTH_HS, HAPPY, SAD or NA by the emoticons in a text."""
    happy, sad = F.rlike(_col(text), F.lit(HAPPY)), F.rlike(_col(text), F.lit(SAD))
    return F.when(happy & sad, "BOTH_HS").when(happy, "HAPPY").when(sad, "SAD").otherwise("NA")


def emoticons(text: Column | str) -> Column:
    """Which kinds of emoticons a text has, as a struct of booleans."""
    return F.struct(*[F.rlike(_col(text), F.lit(p)).alias(k) for k, p in EMOTICON_KINDS.items()])


def has_url(token: Column | str) -> Column:
    return F.rlike(_col(token), F.lit(f"(?Ui){URL}"))


def norm_urls(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), f"(?Ui){URL}", "[URL]")


def nice_label(label: Column | str) -> Column:
    """A label without the beginnings of web addresses."""
    return F.regexp_replace(F.regexp_replace(_col(label), r"\bhttp://", ""), r"\bwww[0-9]?\.", "")


def link_urls(text: Column | str, css: str = "t") -> Column:
    """URLs as anchors; those without a scheme get one in the target."""
    linked = F.regexp_replace(_col(text), f"(?Ui)({URL})", f'<a class="{css}" target="_blank" href="http://$1">$1</a>')
    return F.regexp_replace(linked, f'(?i)(<a class="{css}" target="_blank" href=")http://(?=http)', "$1")


#: Fixed value: where messages' authors are found.
PEOPLE = "http://twitter.com/"


def link_mentions(text: Column | str, base: str = PEOPLE) -> Column:
    return F.regexp_replace(_col(text), r"(?U)@(\w+)", f'<a class="at" target="_blank" href="{base}$1">@$1</a>')


def escape_html(text: Column | str) -> Column:
    s = _col(text)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def encode_url(text: Column | str) -> Column:
    """A text as a part of a URL's query."""
    return F.url_encode(_col(text))


def plain_ascii(text: Column | str) -> Column:
    """Other than ASCII characters as numeric references."""
    chars = F.split(_col(text), "")
    return F.array_join(F.transform(chars, lambda c: F.when(F.ascii(c) > 127, F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))).otherwise(c)), "")


def rejoin_clitics(tokens: Column | str) -> Column:
    """An apostrophe and a following token ``s``, ``t`` or ``m`` as one token."""
    joined = F.regexp_replace(F.array_join(_col(tokens), " "), r"( |^)(') ([stm])( |$)", "$1$2$3$4")
    return F.filter(F.split(joined, " "), lambda t: t != "")


def subset(tokens: Column | str, places: Column) -> Column:
    """The tokens (or their offsets) at places from 0."""
    return F.transform(places, lambda i: F.element_at(_col(tokens), i + 1))


def is_phone(agent: Column | str) -> Column:
    return F.rlike(_col(agent), F.lit("Mobile.*Safari"))


def label_html(label: Column | str, phone: bool = False) -> Column:
    """A topic's label for a page; the leftovers' is ``more...``, and nothing on a phone."""
    c = _col(label)
    safe = c
    for raw, mark in (('"', "&quot;"), (">", "&gt;"), ("<", "&lt;"), *([(" ", "&nbsp;")] if phone else [])):
        safe = F.replace(safe, F.lit(raw), F.lit(mark))
    return F.when(c == "**EXTRAS**", F.lit("" if phone else "<i>more...</i>")).otherwise(safe)


# Codes of a terminal's colours.
COLOURS = {"reset": 0, "bold": 1, "black": 30, "red": 31, "green": 32, "yellow": 33, "blue": 34, "magenta": 35, "cyan": 36, "white": 37}


def coloured(text: Column | str, *names: str) -> Column:
    """A text between a terminal's codes; bold stands next to it."""
    if not names:
        raise ValueError("name a colour")
    codes = [F.lit(f"\x1b[{COLOURS[n]}m") for n in sorted(names, key=lambda n: n == "bold")]
    return F.concat(*codes, _col(text), F.lit("\x1b[0m"))


def pluralize(n: Column | str, unit: str) -> Column:
    c = _col(n)
    return F.concat(c.cast("string"), F.when(c == 1, F.lit(f" {unit}")).otherwise(F.lit(f" {unit}s")))


def nice_timedelta(seconds: Column | str) -> Column:
    """A span of whole seconds in its largest unit: days, hours, minutes or seconds."""
    s = _col(seconds).cast("long")
    day, rest = F.floor(s / 86400), s % 86400
    return (
        F.when(day > 0, pluralize(day, "day"))
        .when(rest > 3600, pluralize(F.floor(rest / 3600), "hour"))
        .when(rest > 60, pluralize(F.floor(rest / 60), "minute"))
        .otherwise(pluralize(rest, "second"))
    )


def clock(seconds: Column | str) -> Column:
    """``12s``, ``3m:07s`` or ``1:02:03``."""
    s = _col(seconds).cast("long")
    minutes, rest = F.floor(s / 60) % 60, s % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(minutes.cast("string"), F.lit("m:"), two(rest), F.lit("s")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(minutes), F.lit(":"), two(rest)))
    )


def si_number(x: Column | str) -> Column:
    """A positive number with three digits or so and the name of its power of a thousand."""
    v = _col(x).cast("double")
    digits = F.when(v >= 1, F.floor(F.log10(v))).otherwise(F.ceil(F.log10(v))).cast("int")
    shelf = F.greatest(F.lit(-6), F.least(F.lit(9), (F.floor(digits / 3) * 3).cast("int")))
    decimals = F.greatest(F.lit(0), F.lit(2) - F.abs(F.abs(digits) - F.abs(shelf))) + F.when(v < 1, 1).otherwise(0)
    scaled = v / F.pow(F.lit(10.0), shelf)
    shown = F.when(decimals == 0, F.format_string("%.0f", scaled))
    for d in (1, 2, 3):
        shown = shown.when(decimals == d, F.format_string(f"%.{d}f", scaled))
    unit = F.when(shelf == -6, " micro").when(shelf == -3, " milli").when(shelf == 3, " k").when(shelf == 6, " M").when(shelf == 9, " G").otherwise("")
    return F.concat(shown, unit)


def quoted_if_phrase(name: Column | str) -> Column:
    """A search term for a name: in quotes if it has several words."""
    c = _col(name)
    return F.when(F.size(F.split(c, " +")) > 1, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)


def matched(text: Column | str, pattern: str, group: int = 0) -> Column:
    """A group of a pattern's first match; null without one."""
    c = _col(text)
    return F.when(F.rlike(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))


def all_matched(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(group))


def replaced(text: Column | str, pattern: str, by: str) -> Column:
    return F.regexp_replace(_col(text), pattern, by)


def shown_matches(text: Column | str, pattern: str, start: str = "[[", end: str = "]]") -> Column:
    """A text with its matches marked."""
    return F.regexp_replace(_col(text), f"({pattern})", f"{start}$1{end}")


def query_refinement(query: str, label: Column | str) -> Column:
    """The query narrowed to a topic's label; null for the topic of leftovers."""
    c = _col(label)
    plain = F.regexp_replace(c, '["/]', "")
    words = F.filter(F.split(plain, r"\s+"), lambda w: w != "")
    junk = F.exists(words, lambda w: F.rlike(w, F.lit("(?i)^[^a-z0-9@_-]+$")))
    sub = F.when(~junk & (F.size(words) > 1), F.concat(F.lit('"'), F.array_join(words, " "), F.lit('"'))).otherwise(F.array_join(words, " "))
    return F.when(c == "**EXTRAS**", F.lit(None)).otherwise(F.concat(F.lit(query + " "), sub))
