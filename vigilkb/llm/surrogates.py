"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Entities: e-mail addresses, IPv4 addresses, phone, card, social security and account (IBAN)
numbers, and names after a form of address.  Every entity has a kind and a canonical value
(case folded, separators dropped), so one number written in two formats is one entity.  Its
surrogate is drawn from SHA-256 of the key, the kind, the value and an attempt:

* numbers keep their length and format, cards their brand digit and a valid check digit,
  phones their first digit, accounts their country; letters stay letters, digits digits;
* addresses of one domain share a surrogate domain, and keep the last label;
* names are built from syllables of their script (Latin, Greek, Cyrillic); given names get an
  ending of the gender that the form of address tells.  A family name keeps its surrogate with
  and without the given name, and both are also replaced where a document repeats them alone
  (the longest first; a word that is both is taken for the family name).

Equal entities get equal surrogates in the whole corpus.  Collision checks: entities whose
surrogate another entity of the kind has too, or which is itself an entity of the corpus
(for names: a name of any kind), draw again with the next attempt (of several, the smallest value keeps it) until all differ.

Only documents with entities are joined to their replacements.  Cases: null and empty texts
stay; repeated rows and ids are rewritten each; other columns are kept, but for
one named n_entities, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilkb.session import cut

MOST_ATTEMPTS = 64

# Forms of address by gender, and the endings and syllables of the scripts.
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Госпожа", "Κυρία"]
MALE = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"]
SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "ra", "re", "ro", "sa", "se", "so", "ta", "te", "to", "va", "ve", "vo"],
    "greek": ["βα", "βε", "γα", "γε", "δα", "δε", "ζα", "ζε", "κα", "κε", "λα", "λε", "μα", "με", "να", "νε", "πα", "πε", "ρα", "ρε", "σα", "σε", "τα", "τε"],
    "cyrillic": ["ба", "бе", "ва", "ве", "га", "ге", "да", "де", "за", "зе", "ка", "ке", "ла", "ле", "ма", "ме", "на", "не", "ра", "ре", "са", "се", "та", "те"],
}
ENDINGS = {
    "latin": {"f": "lia", "m": "lon", "n": "ner"}, "greek": {"f": "λια", "m": "λος", "n": "νης"}, "cyrillic": {"f": "лия", "m": "лон", "n": "нер"},
}

_NAME_WORD = r"\p{Lu}[\p{L}'’-]{1,30}"
_ADDRESS = "(?:" + "|".join(sorted(FEMALE + MALE, key=len, reverse=True)) + r")\.?"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\w)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]{0,2}\d{2,4}){2,4}(?!\w)|(?<![\w(+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])(?:\d{4}[ -]?){3}\d{1,7}(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "name": rf"(?<!\p{{L}}){_ADDRESS} {_NAME_WORD}(?: {_NAME_WORD}){{0,2}}",
}
#: No entity begins inside a word, which the first look-behind settles for most places at once.
ENTITY = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: What a text with an entity has at least: a digit, or a form of address.
_SHORT = [a for a in FEMALE + MALE if not any(a != b and a.startswith(b) for b in FEMALE + MALE)]

_PARTS = "array<struct<kind:string,value:string,shown:string,lead:string>>"


def _drawn(digest: Column, i: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(digest, i), F.lit(n)).cast("int")


def _same_class(digest: Column, text: Column) -> Column:
    """Every letter by a letter and every digit by a digit; the rest stays."""
    def one(c: Column, i: Column) -> Column:
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _drawn(digest, i, 26) + 1, F.lit(1))
        return (
            F.when(c.rlike("[0-9]"), _drawn(digest, i, 10).cast("string"))
            .when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)
        )
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _checked(digits: Column) -> Column:
    """The digits but the last, and the digit that makes their Luhn sum a multiple of ten."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    n = F.length(body)
    worth = F.transform(F.split(body, ""), lambda c, i: F.when((n - i) % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    total = F.aggregate(worth, F.lit(0), lambda a, x: a + x)
    return F.concat(body, F.pmod(-total, F.lit(10)).cast("string"))


def _name(digest: Column, kind: Column, attempt: Column) -> Column:
    """Two to four syllables (one more after some attempts) and the ending; the script and gender are in the kind."""
    def of(script: str, gender: str) -> Column:
        sounds = F.array(*[F.lit(s) for s in SYLLABLES[script]])
        many = 2 + _drawn(digest, F.lit(-1), 2) + F.floor(attempt / 4).cast("int")
        said = F.transform(F.sequence(F.lit(1), many), lambda i: F.get(sounds, _drawn(digest, i, len(SYLLABLES[script]))))
        return F.initcap(F.concat(F.array_join(said, ""), F.lit(ENDINGS[script][gender])))
    out = None
    for script in SYLLABLES:
        for gender in "fmn":
            when = kind.endswith(f"{gender}_{script}")
            out = F.when(when, of(script, gender)) if out is None else out.when(when, of(script, gender))
    return out


def surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The canonical surrogate of a canonical value."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string")), 256)
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    last = F.substring_index(domain, ".", -1)
    labels = F.substring(domain, F.lit(1), F.length(domain) - F.length(last) - 1)
    of_domain = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain), 256)
    drawn = _same_class(digest, value)
    return (
        F.when(kind == "email", F.concat(_same_class(digest, local), F.lit("@"), _same_class(of_domain, labels), F.lit("."), last))
        .when(kind == "ip", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_drawn(digest, i, 254) + 1).cast("string")), "."))
        .when(kind == "card", _checked(F.concat(F.substring(value, 1, 1), F.substring(drawn, F.lit(2), F.length(value)))))
        .when(kind == "phone", F.concat(F.substring(value, 1, 1), F.substring(drawn, F.lit(2), F.length(value))))
        .when(kind == "iban", F.concat(F.substring(value, 1, 2), F.substring(drawn, F.lit(3), F.length(value))))
        .when(kind == "ssn", drawn)
        .otherwise(_name(digest, kind, attempt))
    )


def _rendered(kind: Column, shown: Column, drawn: Column) -> Column:
    """The surrogate in the format in which the entity stands in the text."""
    nth = lambda i: F.length(F.regexp_replace(F.substring(shown, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
    filled = F.array_join(F.transform(F.split(shown, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(drawn, nth(i), F.lit(1))).otherwise(c)), "")
    cased = F.when((shown == F.upper(shown)) & (F.length(shown) > 1), F.upper(drawn)).otherwise(drawn)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), filled).when(kind == "ip", drawn).otherwise(cased)


def _parts(found: Column) -> Column:
    """What an entity is made of: one part, or for a name one part per word, with the text before it."""
    def part(kind, value, shown, lead="") -> Column:
        lead = F.lit(lead) if isinstance(lead, str) else lead
        return F.struct(kind.alias("kind"), value.alias("value"), shown.alias("shown"), lead.alias("lead"))

    plain = F.regexp_replace(found, "[^0-9A-Za-z]", "")
    address = F.regexp_extract(found, f"^{_ADDRESS}", 0)
    gender = F.when(F.regexp_replace(address, r"\.", "").isin(*FEMALE), "f").otherwise("m")
    words = F.split(F.substring(found, F.length(address) + 2, F.length(found)), " ")
    script = lambda w: F.when(w.rlike(r"^\p{IsGreek}"), "greek").when(w.rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    name = F.transform(
        words,
        lambda w, i: part(
            F.concat_ws("_", F.when(i < F.size(words) - 1, F.concat(F.lit("given_"), gender)).otherwise("family_n"), script(w)),
            F.lower(w), w, F.when(i == 0, F.concat(address, F.lit(" "))).otherwise(" "),
        ),
    )
    return (
        F.when(found.contains("@"), F.array(part(F.lit("email"), F.lower(found), found)))
        .when(found.rlike(rf"^{_ADDRESS} "), name)
        .when(found.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), F.array(part(F.lit("ip"), found, found)))
        .when(found.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.array(part(F.lit("ssn"), plain, found)))
        .when(found.rlike("^[A-Z]"), F.array(part(F.lit("iban"), plain, found)))
        .when(found.rlike(r"^[+(]"), F.array(part(F.lit("phone"), plain, found)))
        .otherwise(F.array(part(F.lit("card"), plain, found)))
        .cast(_PARTS)
    )


def _taken(drawn: DataFrame) -> DataFrame:
    """(kind, value) that must draw again."""
    shared = drawn.groupBy("kind", "drawn").agg(F.min("value").alias("keeps"), F.count("*").alias("n")).where("n > 1")
    doubles = drawn.join(shared, ["kind", "drawn"]).where("value != keeps").select("kind", "value")
    # names are compared case folded, like the entities they must not repeat
    sort = F.when(F.col("kind").contains("_"), "name").otherwise(F.col("kind")).alias("sort")
    real = drawn.select(sort, F.col("value").alias("folded")).distinct()
    repeats = drawn.withColumn("folded", F.when(F.col("kind").contains("_"), F.lower("drawn")).otherwise(F.col("drawn"))).withColumn("sort", sort).join(real, ["sort", "folded"]).select("kind", "value")
    return doubles.union(repeats).distinct()


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, drawn) for distinct entities (kind, value): distinct and new within their kind."""
    drawn = cut(entities.withColumn("attempt", F.lit(0)).withColumn("drawn", surrogate(key, F.col("kind"), F.col("value"), F.col("attempt"))))
    for _ in range(MOST_ATTEMPTS):
        again = cut(_taken(drawn)).withColumn("again", F.lit(1))
        if again.isEmpty():
            return drawn.select("kind", "value", "drawn")
        next_ = drawn.join(again, ["kind", "value"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0)))
        drawn = cut(
            next_.withColumn("drawn", F.when(F.col("again").isNull(), F.col("drawn")).otherwise(surrogate(key, F.col("kind"), F.col("value"), F.col("attempt"))))
            .drop("again")
        )
    raise ValueError("a kind has too few surrogates for its entities")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text``, and n_entities (long)."""
    names = [c for c in docs.columns if c != "n_entities"]
    same = [F.xxhash64("text").alias("__k1"), F.xxhash64(F.lit("second"), "text").alias("__k2")]
    may = F.col("text").rlike("[0-9@]")
    for address in _SHORT:
        may = may | F.col("text").contains(address)
    has = F.coalesce(may & F.col("text").rlike(ENTITY), F.lit(False))
    held = docs.withColumn("__has", has)
    found = (
        held.where("__has").select("text").distinct()
        .select(*same, F.posexplode(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).alias("at", "found"))
    )
    each = cut(found.select("__k1", "__k2", "at", F.posexplode(_parts(F.col("found"))).alias("part", "e")).select("__k1", "__k2", "at", "part", "e.*"))
    drawn = assign(each.select("kind", "value").distinct(), key)
    shown = each.join(drawn, ["kind", "value"]).withColumn("new", _rendered(F.col("kind"), F.col("shown"), F.col("drawn")))
    said = F.transform(F.array_sort(F.collect_list(F.struct("part", "lead", "new"))), lambda p: F.concat(p["lead"], p["new"]))
    whole = (
        shown.groupBy("__k1", "__k2", "at")
        .agg(F.array_join(said, "").alias("new"), F.collect_list(F.when(F.col("kind").contains("_"), F.struct(-F.length("shown"), F.col("kind").startswith("given"), "kind", "shown", "new"))).alias("names"))
        .groupBy("__k1", "__k2")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("__new"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("__names"),
        )
    )
    between = F.split("text", ENTITY, -1)
    text = F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.get("__new", i), F.lit("")))), "")
    edge = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
    alone = F.aggregate(
        "__names", text,
        lambda t, f: F.regexp_replace(t, F.concat(F.lit(edge[0] + r"\Q"), f["shown"], F.lit(r"\E" + edge[1])), f["new"]),
    )
    changed = (
        held.where("__has").withColumns(dict(zip(("__k1", "__k2"), (F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")), strict=True)))
        .join(whole, ["__k1", "__k2"])
        .withColumn("text", alone).select(*names, F.size("__new").cast("long").alias("n_entities"))
    )
    return held.where(~F.col("__has")).select(*names, F.lit(0).cast("long").alias("n_entities")).unionByName(changed)
