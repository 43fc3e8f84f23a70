"""Replacement of personal data by surrogates of the same kind, in DataFrame operations.

Detected are e-mail addresses, IPv4 addresses, telephone numbers, payment cards (by their check
digit), access keys and values assigned to secret names, social security numbers, bank accounts, and
names after an honorific. All distinct entities of the table are gathered, each gets a surrogate from
a keyed hash, and entities whose surrogates collide with each other or with an entity of the corpus
are given the next one, until all differ; from the fifth attempt on (the 17th for addresses) a surrogate
is a character longer each time, so that there is always room. So one entity has one surrogate everywhere, two have two,
and nobody without the key can tell which belongs to which. Surrogates keep type and format: digits
stay digits and letters letters of their case, separators and prefixes stay, card numbers keep a valid
check digit, addresses lie in a private network, mail goes to a reserved domain, and names keep
gender (by honorific) and script.

A secret's value holds a letter or digit: lines of other characters are no secret. After a colon and a space,
unquoted, as prose has it, it must also have a mark of a key: a digit, one of _+=, a capital after a small
letter, or 24 letters in a row. Passwords need no mark, since any word may be one.

A null or empty text stays as it is; so does every text without entities. Rows that repeat an id or a
text are treated alike, each for itself. All other columns are handed through, only n_chars is
counted anew where there is one, and a column n_entities is replaced. What is gathered of all entities is emptied
once each text has its own surrogates.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, saved

#: type -> Java regex, in order of precedence. No groups that capture.
MALE = r"(?:Mr|Sir|Herrn?|Monsieur|Señor|Sr|Г-н|Господин|Κύριος|Κος)"
FEMALE = r"(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа|Госпожа|Κυρία|Κα)"
SECRET_NAME = r"(?i:[\w-]{0,40}(?:key|token|secret|passw(?:or)?d|passwort|pwd|credential)[\w-]{0,40})"
PASSWORD_NAME = r"(?i:[\w-]{0,40}(?:passw(?:or)?d|passwort|pwd)[\w-]{0,40})"
VALUE = r"(?=[_+/=.-]*[A-Za-z0-9])[A-Za-z0-9_+/=.-]{8,}"
#: What tells a value from a word of prose.
KEY_MARK = r"(?=[A-Za-z/.-]*(?:[0-9_+=]|[a-z][A-Z]|[A-Za-z]{24}))"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]{1,64}@[\w-]+(?:\.[\w-]+)+",
    "secret": rf"{PASSWORD_NAME}\"?\s?[=:]\s?[\"']?{VALUE}|{SECRET_NAME}\"?\s?(?:=\s?[\"']?|:\s?[\"']|:(?!\s)|:\s{KEY_MARK}){VALUE}",
    "aws": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "apikey": r"(?<![A-Za-z0-9])(?:sk|pk|ghp|gho|ghs|glpat|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![\w(])\([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])|(?<![\w.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![\w.-])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![\w-])|(?<![\w.-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![\w-])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "ip": rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?!\w|\.[0-9])",
    "male": MALE + r"\.? \p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?",
    "female": FEMALE + r"\.? \p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: type -> what any entity of it has; a text without all of these is spared the long pattern.
HINTS = {
    "email": "@",
    "secret": r"(?i:key|token|secret|passw|pwd|credential)",
    "aws": r"(?:AKIA|ASIA)[A-Z0-9]",
    "apikey": r"(?:sk|pk|ghp|gho|ghs|glpat|xoxb|xoxp)[-_][A-Za-z0-9_-]",
    "iban": r"[0-9]{2}", "phone": r"[0-9]{2}", "card": r"[0-9]{2}", "ssn": r"[0-9]{2}",
    "ip": r"[0-9]\.[0-9]+\.[0-9]",
    "male": MALE + r"\.? \p{Lu}",
    "female": FEMALE + r"\.? \p{Lu}",
}
HINT = "|".join(dict.fromkeys(HINTS.values()))
DIGITS = ("phone", "card", "ssn")
#: Syllables and gendered endings by script; names are made of them, as long as it takes to differ.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga ge go ha he jo ka ke ko la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se so ta te ti to va ve vi",
    "cyrillic": "ба бе би бо да де ди до ва ве га ге го ка ке ко ла ле ли ло ма ме ми мо на не но па пе ра ре ри ро са се со та те ти то",
    "greek": "βα βε βι βο δα δε δι δο γα γε κα κε κο λα λε λι λο μα με μι μο να νε νο πα πε ρα ρε ρι ρο σα σε σο τα τε τι το",
}
ENDINGS = {
    ("latin", "male"): "n s rt", ("latin", "female"): "na ra lia", ("cyrillic", "male"): "н в р", ("cyrillic", "female"): "на ва ра",
    ("greek", "male"): "ς νος ρης", ("greek", "female"): "να ρα λια",
}


def luhn(digits: Column) -> Column:
    """Check sum of a string of digits, modulo 10."""
    value = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    twice = lambda c: (value(c) * 2) % 10 + F.floor(value(c) / 5).cast("int")
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, value(c)).otherwise(twice(c)))
    return F.aggregate(each, F.lit(0), lambda x, y: x + y) % 10


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, p in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{p})$"), F.lit(name)).otherwise(out)
    return out


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


#: In front of a secret's value and of a name stands what stays.
LEAD = {
    "secret": "^(" + SECRET_NAME + r"\"?\s?[=:]\s?[\"']?)", "male": "^(" + MALE + r"\.? )", "female": "^(" + FEMALE + r"\.? )",
    "apikey": r"^((?:sk|pk|ghp|gho|ghs|glpat|xoxb|xoxp)[-_])", "aws": "^(AKIA|ASIA)", "iban": "^([A-Z]{2})",
}


def lead_of(kind: Column, entity: Column) -> Column:
    out = F.lit("")
    for name, p in LEAD.items():
        out = F.when(kind == name, F.regexp_extract(entity, p, 1)).otherwise(out)
    return out


def hashed(key: str, *parts: Column) -> Column:
    """Hexadecimal digits, 128 for every 32 characters of the last part."""
    base = F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts])
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(parts[-1]) / 32).cast("int")), lambda b: F.sha2(F.concat(base, F.lit("#"), b.cast("string")), 512))
    return F.array_join(blocks, "")


def number(stream: Column, i: Column, most: Column) -> Column:
    return F.conv(F.substring(stream, (i * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int") % most


def same_format(value: Column, stream: Column, hexa: Column) -> Column:
    """Digits for digits and letters for letters, by case; hexadecimal values stay so."""
    pick = lambda chars, i: F.substring(F.lit(chars), number(stream, i, F.lit(len(chars))) + 1, F.lit(1))
    chars = F.transform(
        F.split(value, ""),
        lambda c, i: F.when(hexa, pick("0123456789abcdef", i))
        .when(c.rlike("[0-9]"), pick("0123456789", i))
        .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", i))
        .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i))
        .otherwise(c),
    )
    return F.array_join(chars, "")


def with_surrogates(values: DataFrame, key: str) -> DataFrame:
    """values (kind, value, attempt) with new: digits for number types, a name for a name, else as the value looks.

    Every intermediate value is a column of its own: one expression for all of it grows beyond what can be planned.
    """
    kind, value, stream, figures = (F.col(c) for c in ("kind", "value", "_stream", "_figures"))
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    syllables, endings = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, text in SYLLABLES.items():
        syllables = F.when(F.col("_script") == name, text).otherwise(syllables)
    for (name, gender), text in ENDINGS.items():
        endings = F.when((F.col("_script") == name) & (kind == gender), text).otherwise(endings)
    syllable_numbers = F.sequence(F.lit(0), F.lit(2) + F.floor(F.col("attempt") / 8).cast("int"))
    pick = lambda choices, i: F.element_at(choices, number(stream, i, F.size(choices)) + 1)
    number_at = lambda i, most: number(stream, F.lit(i), F.lit(most)).cast("string")
    shape = F.when(kind == "email", F.substring_index(value, "@", 1)).otherwise(value)
    df = values.withColumns({"_stream": hashed(key, kind, F.col("attempt"), value), "_shape": shape, "_script": script})
    df = df.withColumns({"_hexa": F.col("_shape").rlike("^[0-9a-f]*[a-f][0-9a-f]*$") & F.col("_shape").rlike("[0-9]"), "_syllables": F.split(syllables, " "), "_endings": F.split(endings, " ")})
    # What later attempts add: a hash's digits, as letters where the value has no digit.
    grown = F.greatest(F.col("attempt") - F.when(kind == "ip", 15).otherwise(3), F.lit(0)).cast("int")
    more = F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("more"), kind, F.col("attempt").cast("string"), value), 512), F.lit(1), grown)
    more = F.when(kind.isin(*DIGITS, "ip"), F.translate(more, "abcdef", "012345")).when(F.col("_hexa") | value.rlike("[0-9]"), more).otherwise(F.translate(more, "0123456789", "ghijklmnop"))
    df = df.withColumn("_more", F.when(value.rlike("[A-Z]") & ~value.rlike("[a-z]"), F.upper(more)).otherwise(more))
    df = df.withColumn("_figures", F.concat(same_format(F.col("_shape"), stream, F.col("_hexa")), F.when(kind == "ip", "").otherwise(F.col("_more"))))
    # A card's first digit stays, the last is its check digit; a telephone number's first digit stays.
    df = df.withColumn("_body", F.concat(F.substring(value, 1, 1), F.expr("substring(_figures, 2, length(_figures) - 2)")))
    check = ((10 - luhn(F.concat("_body", F.lit("0")))) % 10).cast("string")
    ip = F.concat(F.lit("10."), number_at(20, 256), F.lit("."), number_at(21, 256), F.lit("."), number_at(22, 256), F.when(F.col("_more") != "", F.concat(F.lit("."), "_more")).otherwise(""))
    name = F.concat(F.array_join(F.transform(syllable_numbers, lambda i: pick(F.col("_syllables"), i)), ""), pick(F.col("_endings"), F.lit(30)))
    new = (
        F.when(kind == "card", F.concat("_body", check)).when(kind == "phone", F.concat(F.substring(value, 1, 1), F.substring(figures, 2, 200)))
        .when(kind == "ip", ip).when(kind == "email", F.concat(figures, F.lit("@mail"), number_at(31, 100), F.lit(".example.org")))
        .when(kind.isin("male", "female"), F.initcap(name)).otherwise(figures)
    )
    return df.select(*values.columns, new.alias("new"))


def canonical(kind: Column, entity: Column) -> Column:
    """Values of an entity that are replaced as wholes: one, but for names one a word."""
    rest = F.substring(entity, F.length(lead_of(kind, entity)) + 1, F.length(entity))
    return (
        F.when(kind.isin(*DIGITS), F.array(digits_of(entity))).when(kind == "email", F.array(F.lower(entity)))
        .when(kind.isin("male", "female"), F.split(rest, " ")).otherwise(F.array(rest))
    )


def distinct_surrogates(values: DataFrame, key: str) -> DataFrame:
    """kind, value, new: no two values of a kind share a surrogate, and none is a value of the corpus.

    Ends for any values: each attempt hashes anew, and the space of surrogates grows with the attempts.
    """
    todo, done, last = values.withColumn("attempt", F.lit(0)), None, []
    taken = values.select("kind", F.col("value").alias("new"))
    while True:
        tried = with_surrogates(todo.select("kind", "value", "attempt"), key)
        every = saved(tried if done is None else done.unionByName(tried), "surrogates")
        # The first to hold a surrogate keeps it: who had it longer, then the smallest value.
        owner = every.groupBy("kind", "new").agg(F.min(F.struct("attempt", "value"))["value"].alias("owner"))
        judged = every.join(owner, ["kind", "new"]).join(taken.withColumn("real", F.lit(True)), ["kind", "new"], "left")
        clash = (F.col("owner") != F.col("value")) | F.col("real").isNotNull()
        after = saved(judged.select("kind", "value", "attempt", "new", clash.alias("clash")), "surrogates-judged")
        forget(every, *last)
        last = [after]
        again = after.where("clash")
        if again.isEmpty():
            return after.select("kind", "value", "new")
        done = after.where("not clash").drop("clash")
        todo = again.select("kind", "value", (F.col("attempt") + 1).alias("attempt"))


def refilled(entity: Column, digits: Column) -> Column:
    """An entity with its digits replaced in order, all else as it stands; digits beyond its own follow."""
    step = F.aggregate(
        F.split(entity, ""),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("n")),
        lambda acc, c: F.when(
            c.rlike("[0-9]"), F.struct(F.concat(acc["out"], F.substring(digits, acc["n"] + 1, F.lit(1))).alias("out"), (acc["n"] + 1).alias("n"))
        ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["n"].alias("n"))),
    )
    return F.concat(step["out"], F.substring(digits, step["n"] + 1, F.length(digits)))


def replaced(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the entities of its texts replaced; n_entities is added, in place of a column of that name."""
    columns = [c for c in docs.columns if c != "n_entities"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").alias("text"))  # no column clashes with those made here
    has = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    some = rows.where(has).withColumn("ents", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    some = some.withColumn("gaps", F.when(F.size("ents") > 0, F.split("text", ANY, -1)))
    some = saved(some.drop("text").withColumn("id", F.monotonically_increasing_id()), "texts-with-entities")
    kinds = F.transform("ents", lambda e: F.struct(kind_of(e).alias("kind"), e.alias("entity")))
    found = some.select("id", F.explode(F.array_distinct(kinds)).alias("e")).select("id", "e.kind", "e.entity")
    found = found.where((F.col("kind") != "card") | (luhn(digits_of(F.col("entity"))) == 0))  # other long numbers stay
    found = saved(found.withColumn("values", canonical(F.col("kind"), F.col("entity"))), "entities")
    values = saved(found.select("kind", F.explode("values").alias("value")).distinct(), "entity-values")
    mapping = distinct_surrogates(values, key)
    entities = found.select("kind", "entity", F.posexplode("values").alias("at", "value")).distinct().join(mapping, ["kind", "value"])
    entities = entities.groupBy("kind", "entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]), " ").alias("new"))
    loud = F.upper("entity") == F.col("entity")
    new = (
        F.when(F.col("kind").isin(*DIGITS), refilled(F.col("entity"), F.col("new")))
        .when((F.col("kind") == "email") & loud, F.upper("new"))
        .otherwise(F.concat(lead_of(F.col("kind"), F.col("entity")), F.col("new")))
    )
    maps = (
        found.select("id", "kind", "entity")
        .join(entities.select("kind", "entity", new.alias("new")), ["kind", "entity"])
        .groupBy("id")
        .agg(F.map_from_entries(F.collect_set(F.struct("entity", "new"))).alias("map"))
    )
    maps = saved(maps, "surrogates-of-texts")
    forget(found, values, mapping)  # what tells all entities of the table, and whose surrogate is whose
    none = F.create_map().cast("map<string,string>")
    joined = some.join(maps, "id", "left").withColumn("map", F.coalesce("map", none))
    pieces = F.zip_with("gaps", "ents", lambda g, e: F.concat(g, F.coalesce(F.element_at("map", e), e, F.lit(""))))
    fresh_text = F.when(F.size("ents") > 0, F.array_join(pieces, "")).otherwise(F.col("row")[text])
    count = F.size(F.filter("ents", lambda e: F.element_at("map", e).isNotNull())).cast("long")
    done = joined.select("row", fresh_text.alias("text"), count.alias("n_entities"))
    rest = rows.where(~has).select("row", "text", F.lit(0).cast("long").alias("n_entities"))

    def column(name: str) -> Column:
        old = F.col("row")[name]
        if name == text:
            return F.col("text").alias(name)
        if name == "n_chars":
            return F.when(F.col("n_entities") > 0, F.length("text").cast(docs.schema[name].dataType)).otherwise(old).alias(name)
        return old.alias(name)

    return done.unionByName(rest).select(*map(column, columns), "n_entities")
