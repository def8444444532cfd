"""Personal data and secrets replaced by keyed surrogates, with DataFrame operations only.

Mentions are found by one pattern. Each is taken apart into what it names (a phone number is its digits, a person a given and a family
name), and every distinct thing gets a surrogate from a keyed hash: the same type, script, gender, letter
case and layout, the same in all documents. Surrogates are checked against each other and against
everything that occurs, and drawn again until all are distinct, so different things stay different. After some
attempts a thing draws from all letters and digits, after some more its surrogate grows, so that attempts come to an end.
A person found once in a text is followed through it: later occurrences of the name, without a title, get the same surrogate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, set_aside, spread_join, text_key, written

#: Titles by gender.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин", "г-н", "Κύριος", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "госпожа", "г-жа", "Κυρία", "κυρία")
ANYONE = ("Dr", "Prof", "Doctor", "Professor", "Doktor", "Professeur", "доктор", "профессор")
#: Attempts after which a surrogate keeps no classes of characters any more, and after which it gets one character longer each time.
WIDER, LONGER = 3, 6
#: Parts that names are made of, by script and gender.
SYLLABLES = {
    "latin": ("ba", "be", "bo", "ca", "da", "de", "do", "fa", "fe", "ga", "go", "ha", "he", "jo", "ka", "la", "le", "lo", "ma", "me", "mo", "na", "no", "pa", "ra", "re", "ro", "sa", "te", "va"),
    "cyrillic": ("ба", "бе", "бо", "ва", "ве", "го", "да", "де", "до", "за", "ка", "ко", "ла", "ле", "ло", "ма", "ме", "мо", "на", "но", "па", "по", "ра", "ро", "са", "се", "со", "та", "те", "то"),
    "greek": ("βα", "βε", "γα", "δα", "δε", "ζα", "θα", "θε", "κα", "κο", "λα", "λε", "μα", "με", "μι", "να", "νε", "νι", "πα", "πε", "ρα", "ρο", "σα", "σε", "τα", "τε", "φα", "φι", "χα", "χρι"),
}
ENDINGS = {
    ("given", "male", "latin"): ("n", "rd", "s", "l"),
    ("given", "any", "latin"): ("ri", "ly", "sse", "que"),
    ("given", "female", "latin"): ("lia", "na", "ra", "tte"),
    ("family", "male", "latin"): ("ndt", "rs", "lt", "nn"),
    ("given", "male", "cyrillic"): ("н", "р", "с", "л"),
    ("given", "any", "cyrillic"): ("ня", "ша", "ли", "ка"),
    ("given", "female", "cyrillic"): ("на", "ра", "ля", "я"),
    ("family", "male", "cyrillic"): ("ров", "нин", "лев", "хов"),
    ("family", "female", "cyrillic"): ("рова", "нина", "лева", "хова"),
    ("given", "male", "greek"): ("ος", "ης", "ας", "ων"),
    ("given", "female", "greek"): ("να", "νη", "ρα", "λη"),
    ("given", "any", "greek"): ("λι", "ρι", "νι", "σι"),
    ("family", "male", "greek"): ("ίδης", "άκης", "όπουλος", "έας"),
    ("family", "female", "greek"): ("ίδου", "άκη", "οπούλου", "έα"),
}

#: Capital letters that initials are made of, by script.
INITIALS = {"latin": "ABCDEFGHJKLMNOPRSTVW", "cyrillic": "АБВГДЕЗИКЛМНОПРСТФ", "greek": "ΑΒΓΔΕΖΗΘΚΛΜΝΠΡΣΤΦΧ"}

#: Country codes of one and of two digits; all others have three.
COUNTRY = r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"

#: A capitalised word of two letters at least, without a possessive 's.
_NAME = r"(?=\p{Lu}[\p{L}'’-])\p{Lu}\p{L}*(?:['’-]\p{L}{2,})*"
_PART = rf"(?:{_NAME}|\p{{Lu}}\.)"
NAME_WORD = rf"(?<![\p{{L}}\p{{N}}_]){_NAME}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What is found, in order of preference where two could begin at the same place.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"\b(?i:password|passwd|pwd|token|secret|api[_-]?key)\b\s{0,3}[=:]\s{0,3}\"?(?=[+/_-]*[A-Za-z0-9])[A-Za-z0-9+/_-]{8,}\"?",
    "access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\b\d{3}[.-])\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "card": r"(?<![\d.])(?:\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\.?\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "name": rf"(?<![\p{{L}}])(?:{'|'.join(MALE + FEMALE + ANYONE)})\b\.? {_PART}(?: {_PART})*",
}
PATTERN = "|".join(PATTERNS.values())


def _by_first_letter(words: tuple[str, ...]) -> str:
    """Alternatives grouped by their first letter, so that most characters of a text fail one comparison."""
    firsts = sorted({w[0] for w in words})
    return "|".join(f"{c}(?:{'|'.join(w[1:] for w in words if w[0] == c)})" for c in firsts)


#: A cheap test that every text with a mention passes: a digit, @, = or :, the head of an access key, or a title.
MAY_HAVE = rf"[0-9@=:]|A(?:KIA|SIA)|(?:{_by_first_letter(MALE + FEMALE + ANYONE)})\b\.? \p{{Lu}}"


def _draw(*parts: Column) -> Column:
    """128 hex digits from the parts."""
    return F.sha2(F.concat_ws("\x1f", *parts), 512)


def _number(draw: Column, i: Column | int) -> Column:
    """The i-th number of a draw, 0 to 65535, for i from 0; after 32 they repeat."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(draw, F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(values: tuple[str, ...] | str, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(number, F.lit(len(values))) + 1)


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _same_kind(text: Column, draw: Column, attempt: Column) -> Column:
    """Every ASCII letter and digit of a lower-case text exchanged; 0 and 1, 2 to 9, and hexadecimal strings stay so for the first attempts."""
    narrow = attempt < WIDER
    hexadecimal = narrow & text.rlike("^[0-9a-f]+$")
    letters, few = "abcdefghijklmnopqrstuvwxyz", "abcdef"

    def one(c: Column, i: Column) -> Column:
        n = _number(draw, i)
        return (
            F.when(c.rlike("[a-f]") & hexadecimal, F.substring(F.lit(few), F.pmod(n, F.lit(6)) + 1, F.lit(1)))
            .when(c.rlike("[a-z]"), F.substring(F.lit(letters), F.pmod(n, F.lit(26)) + 1, F.lit(1)))
            .when(narrow & c.rlike("[01]"), F.pmod(n, F.lit(2)).cast("string"))
            .when(narrow & c.rlike("[0-9]"), (F.pmod(n, F.lit(8)) + 2).cast("string"))
            .when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string"))
            .otherwise(c)
        )

    return F.array_join(F.transform(_characters(text), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10, counted from the last digit."""
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.reverse(_characters(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(twice(c.cast("int"))))
    return F.pmod(F.aggregate(each, F.lit(0), lambda a, d: a + d), F.lit(10))


def _more(kind: Column, draw: Column, attempt: Column) -> Column:
    """What a surrogate is longer by after many attempts: digits for phone and ssn, letters for the others."""
    marks = F.transform(F.sequence(F.lit(LONGER), attempt), lambda i: F.when(kind.isin("phone", "ssn"), F.pmod(_number(draw, 31 - i), F.lit(10)).cast("string")).otherwise(_pick("abcdefghijklmnopqrstuvwxyz", _number(draw, 31 - i))))
    return F.when(attempt < LONGER, "").otherwise(F.array_join(marks, ""))


def _card(digits: Column, draw: Column, attempt: Column) -> Column:
    """Same scheme (first digit), length and Luhn remainder."""
    body = F.concat(F.substring(digits, 1, 1), _same_kind(F.expr("substring(thing, 2, length(thing) - 2)"), draw, attempt))
    return F.concat(body, F.pmod(_luhn(digits) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))


def _iban(thing: Column, draw: Column, attempt: Column) -> Column:
    """Same country and layout, with the check digits (ISO 7064 modulo 97) that the new number needs."""
    body = _same_kind(F.expr("substring(thing, 5)"), draw, attempt)

    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 87, F.lit(97)))

    left = F.aggregate(_characters(F.concat(body, F.substring(thing, 1, 2), F.lit("00"))), F.lit(0), step)
    return F.concat(F.substring(thing, 1, 2), F.lpad((98 - left).cast("string"), 2, "0"), body)


def _ip(text: Column, draw: Column, attempt: Column) -> Column:
    """Octets of the same number of digits for the first attempts; the first is public, unicast."""

    def octet(x: Column, i: Column) -> Column:
        n, size = _number(draw, i), F.length(x)
        low = F.when(size == 3, F.lit(100)).when(size == 2, F.lit(11)).otherwise(F.lit(1))
        span = F.when(size == 3, F.when(i == 0, F.lit(26)).otherwise(F.lit(155))).when(size == 2, F.lit(89)).otherwise(F.lit(9))
        any_size = F.when(i == 0, F.pmod(n, F.lit(115)) + 11).otherwise(F.pmod(n, F.lit(256)))
        return F.when(attempt < WIDER, low + F.pmod(n, span)).otherwise(any_size).cast("string")

    return F.array_join(F.transform(F.split(text, r"\."), octet), ".")


def _name(kind: tuple[str, str, str], draw: Column, attempt: Column) -> Column:
    """Capitalised syllables and an ending; one syllable more at every attempt."""
    stem = F.transform(F.sequence(F.lit(0), attempt + 1), lambda i: _pick(SYLLABLES[kind[2]], _number(draw, i)))
    return F.initcap(F.concat(F.array_join(stem, ""), _pick(ENDINGS[kind], _number(draw, 31))))


def surrogate(kind: Column, thing: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a thing of a kind; columns must be named so."""
    draw = _draw(F.lit(key), kind, thing, attempt.cast("string"))
    tail = F.regexp_extract(thing, r"\.[a-z]+$", 0)
    more = _more(kind, draw, attempt)
    out = F.when(kind == "email", F.concat(more, _same_kind(F.expr("left(thing, length(thing) - length(regexp_extract(thing, '[.][a-z]+$', 0)))"), draw, attempt), tail))
    out = out.when(kind == "card", _card(thing, draw, attempt)).when(kind == "ip", _ip(thing, draw, attempt))
    out = out.when(kind == "iban", _iban(thing, draw, attempt)).when(kind == "access_key", F.concat(F.substring(thing, 1, 4), _same_kind(F.expr("substring(thing, 5)"), draw, attempt)))
    for k in ENDINGS:
        out = out.when(kind == "_".join(k), _name(k, draw, attempt))
    return out.otherwise(F.concat(_same_kind(thing, draw, attempt), more))


def assigned(things: DataFrame, key: str) -> DataFrame:
    """(kind, thing, surrogate) for distinct things (kind, thing); surrogates of a kind are distinct and none is a thing.

    Of things that draw the same surrogate the least keeps it and the others draw again. Every attempt is one
    aggregation of what is left; after the first that is hardly anything. Where few surrogates of a layout are free, attempts widen
    and then lengthen them, so that the number of rounds is bounded by the logarithm of the things.
    """
    things = written(things, "things")
    done = None
    left = things.withColumn("attempt", F.lit(0))
    while True:
        drawn = written(left.withColumn("surrogate", surrogate(F.col("kind"), F.col("thing"), F.col("attempt"), key)), "drawn")
        taken = things.select("kind", F.col("thing").alias("surrogate"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "surrogate"))
        free = drawn.join(taken, ["kind", "surrogate"], "left_anti").groupBy("kind", "surrogate").agg(F.min("thing").alias("thing"))
        free = written(free.select("kind", "thing", "surrogate"), "assigned")
        done = free if done is None else done.unionByName(free)
        left = written(drawn.join(free, ["kind", "thing"], "left_anti").select("kind", "thing", (F.col("attempt") + 1).alias("attempt")), "left")
        if left.isEmpty():
            return done


def _parts(mentions: DataFrame) -> DataFrame:
    """(mention, place, kind, thing, kept): what each distinct mention names. kept is the start of it that stays as it is."""
    mention = F.col("mention")
    title = F.regexp_extract(mention, r"^\S+? ", 0)
    plain_title = F.regexp_replace(F.trim(title), r"\.$", "")
    gender = F.when(plain_title.isin(*FEMALE), "female").when(plain_title.isin(*ANYONE), "any").otherwise("male")
    kind = F.lit("name")
    for k in reversed([k for k in PATTERNS if k != "name"]):
        kind = F.when(mention.rlike(f"^(?:{PATTERNS[k]})$"), k).otherwise(kind)
    kept = (
        F.when(F.col("kind") == "name", title)
        .when(F.col("kind") == "secret", F.regexp_extract(mention, r'^.*?[=:]\s*"?', 0))
        .when(F.col("kind") == "phone", F.regexp_extract(mention, rf"^\+(?:{COUNTRY})", 0))
        .otherwise("")
    )
    rest = F.expr("substring(mention, length(kept) + 1)")
    rows = mentions.withColumn("kind", kind).withColumn("kept", kept).withColumn("rest", rest)
    words = F.split("rest", " ")
    plain = F.when(F.col("kind").isin("phone", "ssn", "card", "iban"), F.regexp_replace("rest", "[^0-9A-Za-z]", "")).when(F.col("kind") == "secret", F.regexp_replace("rest", '"', "")).otherwise(F.col("rest"))

    def of_name(w: Column, i: Column) -> Column:
        role = F.when(i == F.size(words) - 1, "family").otherwise("given")
        script = F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").when(w.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
        # a Latin family name is one thing whoever bears it
        own = F.when((role == "family") & ((script == "latin") | (gender == "any")), "male").otherwise(gender)
        named = F.when(w.endswith("."), F.concat_ws("_", F.lit("initial"), script)).otherwise(F.concat_ws("_", role, own, script))
        return F.struct(i.alias("place"), named.alias("kind"), w.alias("thing"))

    other = F.array(F.struct(F.lit(0).alias("place"), F.col("kind"), F.lower(plain).alias("thing")))
    parts = rows.select("mention", "kept", "rest", F.explode(F.when(F.col("kind") == "name", F.transform(words, of_name)).otherwise(other)).alias("x")).select("mention", "kept", "rest", "x.*")
    return _one_gender(written(parts, "parts"))


def _one_gender(parts: DataFrame) -> DataFrame:
    """parts in which a given name is one thing whatever its title: of the gender that its titles tell, of any if they tell none or both."""
    told = lambda g: F.max(F.when(F.col("kind").startswith(f"given_{g}_"), 1).otherwise(0)) == 1
    script = F.regexp_extract("kind", "[a-z]+$", 0)
    given = parts.where(F.col("kind").startswith("given_")).groupBy("thing", script.alias("script")).agg(told("male").alias("male"), told("female").alias("female"))
    gender = F.when(F.col("male") & ~F.col("female"), "male").when(F.col("female") & ~F.col("male"), "female").otherwise("any")
    given = given.select("thing", F.concat(F.lit("given_"), gender, F.lit("_"), "script").alias("of"), F.col("script").alias("in_script"))
    joined = spread_join(parts.withColumn("in_script", F.when(F.col("kind").startswith("given_"), script)), given, ["thing", "in_script"], "left", ["mention"])
    return joined.select("mention", "kept", "rest", "place", F.coalesce("of", "kind").alias("kind"), "thing")


def _laid_out(template: Column, characters: Column) -> Column:
    """The surrogate's letters and digits in the template's layout and letter case; what is longer goes to the end, within quotes."""
    clean = _characters(F.regexp_replace(characters, "[^0-9A-Za-z]", ""))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))

    def place(a: Column, c: Column) -> Column:
        x = F.coalesce(F.get(clean, a.i - 1), c)
        x = F.when(c.rlike("[A-Z]"), F.upper(x)).otherwise(x)
        return F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(a.out, x).alias("out"), (a.i + 1).alias("i"))).otherwise(F.struct(F.concat(a.out, c).alias("out"), a.i.alias("i")))

    def ended(a: Column) -> Column:
        over = F.array_join(F.slice(clean, a.i, F.greatest(F.size(clean) - a.i + 1, F.lit(0))), "")
        return F.when(over == "", a.out).otherwise(F.concat(F.regexp_replace(a.out, '"$', ""), over, F.regexp_extract(a.out, '"$', 0)))

    return F.aggregate(_characters(template), start, place, ended)


def replacements(mentions: DataFrame, key: str) -> DataFrame:
    """(mention, replacement, names) for distinct mentions; names: what persons' given and family names (thing) become (new).

    Initials are not things of their own: there are too few to be told apart. They get a keyed letter each.
    """
    parts = written(_parts(mentions), "parts")
    initial = F.col("kind").startswith("initial_")
    given = assigned(parts.where(~initial).select("kind", "thing").distinct(), key)
    joined = spread_join(parts, given, ["kind", "thing"], "left", ["mention"])
    letter = F.lit("")
    for script, letters in INITIALS.items():
        letter = F.when(F.col("kind") == f"initial_{script}", _pick(letters, _number(_draw(F.lit(key), F.col("kind"), F.col("thing")), 0))).otherwise(letter)
    joined = joined.withColumn("surrogate", F.when(initial, F.concat(letter, F.lit("."))).otherwise(F.col("surrogate")))
    is_name = F.col("kind").startswith("given_") | F.col("kind").startswith("family_")
    grown = (F.col("kind") == "email") & (F.length("surrogate") > F.length("rest"))
    new = F.when(is_name | initial | grown | (F.col("kind") == "ip"), F.col("surrogate")).otherwise(_laid_out(F.col("rest"), F.col("surrogate")))
    followed = F.when(is_name, F.col("thing"))
    own = joined.select("mention", "kept", F.struct("place", new.alias("new"), followed.alias("thing")).alias("x"))
    whole = own.groupBy("mention", "kept").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    names = F.transform(F.filter("xs", lambda x: x.thing.isNotNull()), lambda x: F.struct(x.thing.alias("thing"), x.new.alias("new")))
    return whole.select("mention", F.concat("kept", F.array_join(F.transform("xs", lambda x: x.new), " ")).alias("replacement"), names.alias("names"))


def _woven(gaps: Column, between: Column) -> Column:
    """Gaps and what lies between them, as one text."""
    return F.array_join(F.flatten(F.zip_with(gaps, between, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")


def surrogates(docs: DataFrame, key: str = "surrogate key", column: str = "text") -> DataFrame:
    """docs with every mention in ``column`` replaced, and n_replaced, the number of mentions, as the last column (``free_name``: n_replaced_ beside
    a column of that name); all other columns stay, whatever their names.

    Null and empty texts stay, with 0. Texts without a mention are not shuffled; of the others each distinct text is looked up
    once, and neither a mention that very many texts have nor a text of very many rows comes together in one task. Repeated rows get equal texts. The pattern reads whole texts. ``key`` is a secret of the caller:
    without it surrogates cannot be traced back, with it reruns agree.
    """
    number = free_name(docs, "n_replaced")
    docs, back = set_aside(docs, column)
    text = F.col(column)
    has = F.coalesce(text.rlike(MAY_HAVE) & text.rlike(PATTERN), F.lit(False))
    untouched = docs.where(~has).withColumn("n_replaced", F.lit(0).cast("long"))
    found = docs.where(has).withColumn("_key", text_key(text)).withColumn("_mentions", F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    per_text = found.groupBy("_key").agg(F.first("_mentions").alias("_mentions"), F.count("*").alias("n"))
    per_text = written(per_text.select("_key", F.array_distinct("_mentions").alias("mentions"), "n"), "mentions")
    mentions = per_text.select("_key", F.explode("mentions").alias("mention"))
    new = written(replacements(mentions.select("mention").distinct(), key), "replacements")
    each = spread_join(mentions, new, ["mention"], by=["_key"])
    maps = each.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("mention", "replacement"))).alias("_new"))
    names = each.select("_key", F.explode("names").alias("x")).groupBy("_key", F.col("x.thing").alias("thing")).agg(F.min("x.new").alias("new"))
    names = names.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("thing", "new"))).alias("_names"))
    maps = written(maps.join(names, "_key", "left"), "maps")
    limit = max(200, (per_text.agg(F.sum("n")).first()[0] or 0) / 1000)
    hot = [r.h for r in per_text.where(F.col("n") > limit).select(F.xxhash64("_key").alias("h")).collect()]
    joined = spread_join(found.withColumn("_row", F.monotonically_increasing_id()), maps, ["_key"], by=["_row"], hot=hot)
    gaps = F.split(text, PATTERN, -1)
    word = F.lit(NAME_WORD)
    follow = lambda g: _woven(F.split(g, NAME_WORD, -1), F.transform(F.regexp_extract_all(g, word, F.lit(0)), lambda w: F.coalesce(F.element_at("_names", w), w)))
    followed = F.when(F.col("_names").isNull(), gaps).otherwise(F.transform(gaps, follow))
    filled = _woven(followed, F.transform("_mentions", lambda m: F.element_at("_new", m)))
    joined = joined.withColumn("n_replaced", F.size("_mentions").cast("long")).withColumn(column, filled)
    out = untouched.unionByName(joined.drop("_key", "_row", "_mentions", "_new", "_names"))
    return back(out.withColumnRenamed("n_replaced", number))
