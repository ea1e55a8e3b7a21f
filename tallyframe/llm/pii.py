"""Surrogates for personal data; DataFrame operations only.

Detected entities are replaced by keyed surrogates of their own type: digits stay digits, letters letters of their case
and script, addresses stay addresses, card numbers that pass the check digit still pass it, and names follow the gender of
their title, their script and their hyphens. The surrogate depends on the key and the entity's canonical form only, so each
mention of an entity, in any of its formats, gets the same one. Names are learned from mentions after a title; a
capitalised word of the same document that is one of those names is a mention of it too, as a last name first. Over all
entities of the corpus surrogates are checked: one that another entity has, or that is itself an entity of the corpus, is
drawn anew. Where a type's numbers of one length are so many that draws keep failing, all of them go through a keyed
permutation of that length's numbers: distinct by construction, though some may then equal another entity's number.

Not detected: names that never follow a title in their document, initials, and part of a hyphened name by itself. A phone
number with its country code and one without it are two entities.

Defined cases: a null text stays null, with 0 entities; texts without entities stay as they are; a null id is kept; rows
that repeat an id and text get the same text; an empty table gives no rows; a null or empty key is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Titles and the gender that they tell; "n" for none. Fixed values.
TITLES = {
    "Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Señora": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr": "n", "Prof": "n", "Доктор": "n",
}
#: First names and syllables of last names by script. Fixed values.
FIRST_NAMES = {
    "m": ("Adrian", "Bruno", "Casimir", "Damian", "Emil", "Fabian", "Gregor", "Hugo", "Ivan", "Jonas", "Konrad", "Leon", "Marco", "Nils", "Oskar", "Pablo"),
    "f": ("Alma", "Bianca", "Clara", "Daria", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Karla", "Lucia", "Marta", "Nora", "Olga", "Paula"),
    "n": ("Alex", "Andrea", "Ariel", "Charlie", "Dominique", "Jamie", "Kim", "Luca", "Mika", "Noa", "Robin", "Sam", "Sasha", "Simone", "Toni", "Yael"),
}
CYRILLIC_NAMES = {
    "m": ("Артём", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Кирилл", "Максим"),
    "f": ("Алла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Ирина", "Марина"),
    "n": ("Валя", "Женя", "Саша", "Слава"),
}
GREEK_NAMES = {
    "m": ("Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος", "Χρήστος"),
    "f": ("Άννα", "Βασιλική", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία", "Χρυσάνθη"),
    "n": ("Άρτεμις", "Φοίβη", "Πάρις", "Ήλιος"),
}
SYLLABLES = ("ba", "cor", "del", "fan", "gri", "hol", "jan", "kel", "lor", "mar", "nel", "pol", "rin", "sta", "tor", "vel")
CYRILLIC = ("ба", "кор", "дел", "фан", "гри", "хол", "ян", "кел", "лор", "мар", "нел", "пол", "рин", "ста", "тор", "вел")
GREEK = ("βα", "κορ", "δελ", "φαν", "γρι", "χολ", "ιαν", "κελ", "λορ", "μαρ", "νελ", "πολ", "ριν", "στα", "τορ", "βελ")
NAME = r"\p{Lu}(?:['’]\p{Lu})?\p{L}{1,30}(?:-\p{Lu}\p{L}{1,30}){0,3}"
TITLE = rf"(?:{'|'.join(TITLES)})\.? "
#: Types of entities and their patterns, tried in this order. Runs are entered at their start only, so that no text,
#: however long its runs, is read more than a few times.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"),
    ("ip", r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}(?![0-9]|\.[0-9])"),
    ("ipv6", r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]{0,30}[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"),
    ("phone", r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
              r"|(?<![0-9A-Za-z.(+-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-]|\.[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{4}){2,7}[A-Z0-9]{0,3}(?![0-9A-Za-z])"),
    ("name", rf"(?<!\p{{L}}){TITLE}{NAME}(?: {NAME}){{0,2}}(?!\p{{L}})"),
)
ANY = "|".join(p for _, p in PATTERNS)
#: Texts with a titled name are cut at each capitalised word as well, which may be a bare mention.
TITLED = PATTERNS[-1][1]
ANY_OR_WORD = rf"{ANY}|(?<!\p{{L}}){NAME}(?!\p{{L}})"
#: A text without one of these has no entity.
HINT = rf"[0-9]|@|{TITLE}\p{{Lu}}"
#: Draws before numbers of a fixed length are permuted instead; other types have longer surrogates in each further draw.
DRAWS = 12
FIXED_LENGTH = ("phone", "ssn", "card")


def kind(mention: Column) -> Column:
    found = F.lit("word")
    for name, pattern in reversed(PATTERNS):
        found = F.when(mention.rlike(rf"^(?:{pattern})$"), name).otherwise(found)
    return found


def stream(key: str, type_: Column, canonical: Column, attempt: Column) -> Column:
    """128 keyed hexadecimal digits."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), attempt.cast("string"), type_, canonical), 512)


def nibble(hex_: Column, i: Column) -> Column:
    """The number 0 to 255 at place i of the stream, which repeats."""
    return F.conv(F.substring(hex_, F.pmod(i * 2, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int")


def pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))


def masked(text: Column, hex_: Column) -> Column:
    """Each digit or letter replaced by another of its class."""

    def one(c: Column, i: Column) -> Column:
        n = nibble(hex_, i)
        return (
            F.when(c.rlike("[0-9]"), pick("0123456789", n)).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", n))
            .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def luhn_rest(digits: Column) -> Column:
    """The sum of the check-digit rule modulo 10; 0 if the number passes."""
    n = F.length(digits)

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.pmod(F.aggregate(F.transform(F.split(digits, ""), weigh), F.lit(0), lambda s, x: s + x), F.lit(10))


def of_words(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


def spelled(syllables: Column, hex_: Column, count: Column) -> Column:
    parts = F.transform(F.sequence(F.lit(1), count), lambda i: F.element_at(syllables, F.pmod(nibble(hex_, i + 7), F.size(syllables)) + 1))
    return F.array_join(parts, "")


def check_digit(number: Column, like: Column) -> Column:
    """The number with the last digit that makes it pass, or fail, the check as `like` does."""
    body = lambda x: F.substring(x, F.lit(1), F.length(x) - 1)
    right = lambda x: F.pmod(10 - luhn_rest(F.concat(body(x), F.lit("0"))), F.lit(10))
    last = F.substring(like, -1, 1).cast("int")
    return F.concat(body(number), F.pmod(right(number) + last - right(like), F.lit(10)).cast("string"))


def invented_name(type_: Column, canonical: Column, hex_: Column, attempt: Column) -> Column:
    """A name of the type's gender and the script of canonical; it has two parts where canonical has a hyphen."""
    cyrillic, greek = canonical.rlike(r"\p{IsCyrillic}"), canonical.rlike(r"\p{IsGreek}")
    by_script = lambda a, b, c: F.when(cyrillic, b).when(greek, c).otherwise(a)
    syllables = by_script(of_words(SYLLABLES), of_words(CYRILLIC), of_words(GREEK))
    names = by_script(of_words(FIRST_NAMES["n"]), of_words(CYRILLIC_NAMES["n"]), of_words(GREEK_NAMES["n"]))
    for g in ("m", "f"):
        names = F.when(type_ == f"first_{g}", by_script(of_words(FIRST_NAMES[g]), of_words(CYRILLIC_NAMES[g]), of_words(GREEK_NAMES[g]))).otherwise(names)
    ending = F.when(~cyrillic, "").when(canonical.rlike("(?:а|ая)$"), "ова").otherwise("ов")

    def part(h: Column) -> Column:
        first = F.concat(F.element_at(names, F.pmod(nibble(h, F.lit(0)), F.size(names)) + 1), F.when(attempt > 0, spelled(syllables, h, attempt)).otherwise(""))
        return F.when(type_ == "last", F.concat(F.initcap(spelled(syllables, h, attempt + 3)), ending)).otherwise(first)

    return F.when(canonical.contains("-"), F.concat_ws("-", part(hex_), part(F.reverse(hex_)))).otherwise(part(hex_))


def surrogate(type_: Column, canonical: Column, attempt: Column, hex_: Column) -> Column:
    """Canonical surrogate of a canonical entity, from its stream. Those of names are capitalised."""
    domain = F.substring_index(canonical, "@", -1)
    email = F.concat(
        masked(F.substring_index(canonical, "@", 1), hex_), F.when(attempt > 4, attempt.cast("string")).otherwise(""), F.lit("@"),
        masked(F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), F.reverse(hex_)), F.lit("."), F.substring_index(domain, ".", -1),
    )
    ip = F.concat_ws(".", *[(F.pmod(nibble(hex_, F.lit(i)), F.lit(254)) + 1).cast("string") for i in range(4)])
    ipv6 = F.concat_ws(":", *[F.substring(hex_, 4 * i + 1, 4) for i in range(8)])
    iban = F.concat(F.substring(canonical, 1, 2), masked(F.substring(canonical, F.lit(3), F.length(canonical)), hex_))
    same_first = F.concat(F.substring(canonical, 1, 1), masked(F.substring(canonical, F.lit(2), F.length(canonical)), hex_))
    return (
        F.when(type_ == "email", email).when(type_ == "ip", ip).when(type_ == "ipv6", ipv6).when(type_ == "card", check_digit(same_first, canonical))
        .when(type_ == "iban", iban).when(type_ == "phone", same_first).when(type_ == "ssn", masked(canonical, hex_)).otherwise(invented_name(type_, canonical, hex_, attempt))
    )


def permuted(type_: Column, canonical: Column, key: str) -> Column:
    """A keyed permutation of the numbers with this type, length and first digit: a Feistel network over decimal halves.

    For cards the check digit stays outside and follows, so that numbers pass the check as before.
    """
    n = F.length(canonical)
    inner = F.when(type_ == "card", n - 2).otherwise(n - 1)
    half = F.floor(inner / 2).cast("int")
    left, right = F.substring(canonical, F.lit(2), half), F.substring(canonical, half + 2, inner - half)
    tweak = F.concat(type_, n.cast("string"), F.substring(canonical, 1, 1))

    def moved(value: Column, other: Column, size: Column, turn: Column) -> Column:
        drawn = F.conv(F.substring(stream(key, tweak, other, -1 - turn), 1, 15), 16, 10).cast("long")
        return F.lpad(F.pmod(value.try_cast("long") + drawn, F.pow(F.lit(10), size).cast("long")).cast("string"), size, F.lit("0"))

    # Halves of at most ten digits; each round adds a keyed number to one of them, by the other.
    def turned(x: Column, turn: Column) -> Column:
        l, r = x["l"], x["r"]
        on_left = turn % 2 == 0
        return F.struct(F.when(on_left, moved(l, r, half, turn)).otherwise(l).alias("l"), F.when(on_left, r).otherwise(moved(r, l, inner - half, turn)).alias("r"))

    mixed = F.aggregate(F.sequence(F.lit(0), F.lit(5)), F.struct(left.alias("l"), right.alias("r")), turned, lambda x: F.concat(x["l"], x["r"]))
    whole = F.concat(F.substring(canonical, 1, 1), mixed)
    return F.when(type_ == "card", check_digit(F.concat(whole, F.lit("0")), canonical)).otherwise(whole)


def dressed(type_: Column, mention: Column, sub: Column) -> Column:
    """The canonical surrogate in the mention's format: its separators for numbers, its capitals for addresses."""

    def digit(c: Column, i: Column) -> Column:
        so_far = F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]"), F.substring(sub, so_far, F.lit(1))).otherwise(c)

    numbers = F.array_join(F.transform(F.split(mention, ""), digit), "")
    capitals = F.when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(sub)).otherwise(sub)
    return F.when(type_.isin(*FIXED_LENGTH), numbers).otherwise(capitals)


def distinct_surrogates(entities: DataFrame, key: str, draws: int = DRAWS) -> DataFrame:
    """type, canonical, sub for distinct entities (type, canonical); sub is distinct within a type and no entity.

    A drawn surrogate goes to the smallest entity that drew it. Entities without one draw again; after `draws` rounds
    numbers of fixed length are permuted with all others of their type, length and first digit.
    """
    # Drawing costs far more than its few bytes tell, so small tables are spread over the cluster as well.
    spread = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    domain = (F.col("type"), F.length("canonical"), F.substring("canonical", 1, 1))
    todo, done, n = entities.repartition(spread, "type", "canonical"), None, 0
    while True:
        if n == draws:
            dense = todo.where(F.col("type").isin(*FIXED_LENGTH)).select(F.concat_ws(":", *domain).alias("d")).distinct()
            within = lambda rows, how: rows.withColumn("d", F.concat_ws(":", *domain)).join(dense, "d", how).drop("d")
            last = within(entities, "left_semi").select("type", "canonical", permuted(F.col("type"), F.col("canonical"), key).alias("sub"))
            done = last if done is None else within(done, "left_anti").unionByName(last)
            todo = within(todo, "left_anti")
            if not todo.limit(1).count():
                return checkpointed(done)
        hexed = todo.select("type", "canonical", stream(key, F.col("type"), F.col("canonical"), F.lit(n)).alias("hex"))
        drawn = hexed.select("type", "canonical", surrogate(F.col("type"), F.col("canonical"), F.lit(n), F.col("hex")).alias("sub"))
        # Few rows per surrogate are left after partial aggregation, however many entities drew it.
        drawn = drawn.groupBy("type", F.lower("sub").alias("low")).agg(F.min_by("sub", "canonical").alias("sub"), F.min("canonical").alias("canonical"))
        drawn = drawn.join(entities.select("type", F.col("canonical").alias("low")), ["type", "low"], "left_anti")
        if done is not None:
            drawn = drawn.join(done.select("type", F.lower("sub").alias("low")), ["type", "low"], "left_anti")
        new = checkpointed(drawn.select("type", "canonical", "sub"))
        done = new if done is None else done.unionByName(new)
        todo = checkpointed(todo.join(new, ["type", "canonical"], "left_anti"))
        n += 1
        if not todo.limit(1).count():
            return done


def grouped_ipv6(mention: Column) -> Column:
    """Eight groups of four lower-case digits."""
    sides = F.transform(F.split(F.lower(mention), "::", -1), lambda x: F.transform(F.split(x, ":"), lambda g: F.lpad(g, 4, "0")))
    before, after = F.element_at(sides, 1), F.when(F.size(sides) > 1, F.element_at(sides, -1)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(before, F.array_repeat(F.lit("0000"), 8 - F.size(before) - F.size(after)), after), ":")


def replace_personal_data(docs: DataFrame, key: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text with surrogates, n_entities and kinds (type:count, sorted) for each row of docs.

    Who knows the key can search for an original by trying all; keep it secret. Only texts with entities are shuffled,
    once, to meet their surrogates.
    """
    if not key:
        raise ValueError("surrogates need a key")
    rows = docs.select(F.col(id).alias("i"), F.col(text).alias("t"))
    named = F.col("t").rlike(TITLED)
    cut_at = lambda f: F.when(named, f(F.lit(ANY_OR_WORD))).otherwise(f(F.lit(ANY)))
    found = F.when(F.col("t").rlike(HINT), cut_at(lambda p: F.regexp_extract_all("t", p, F.lit(0))))
    marked = rows.withColumn("mentions", F.coalesce(found, F.array().cast("array<string>")))
    bearing = marked.where(F.size("mentions") > 0).withColumn("key", F.md5(F.concat_ws("\x1f", F.coalesce(F.col("i").cast("string"), F.lit("null")), "t")))
    mention = F.col("mention")
    each = bearing.select("key", F.posexplode("mentions").alias("at", "mention")).withColumn("type", kind(mention))
    gender = F.lit("n")
    for title, g in TITLES.items():
        gender = F.when(mention.rlike(rf"^{title}\.? "), g).otherwise(gender)
    names = F.split(F.regexp_replace(mention, rf"^{TITLE}", ""), " ")
    title = F.regexp_extract(mention, r"^\S+ ", 0)
    part = lambda i, type_, prefix, shown, canonical: F.struct(i.cast("int").alias("part"), type_.alias("type"), prefix.alias("prefix"), shown.alias("shown"), canonical.alias("canonical"))
    digits = F.regexp_replace(mention, "[^0-9]", "")
    octets = F.array_join(F.transform(F.split(mention, r"\."), lambda x: x.cast("int").cast("string")), ".")
    plain = (
        F.when(F.col("type").isin("email", "word"), F.lower(mention)).when(F.col("type").isin(*FIXED_LENGTH), digits)
        .when(F.col("type") == "ip", octets).when(F.col("type") == "ipv6", grouped_ipv6(mention)).otherwise(mention)
    )
    of_name = F.transform(names, lambda x, i: part(i, F.when(i == F.size(names) - 1, "last").otherwise(F.concat(F.lit("first_"), gender)), F.when(i == 0, title).otherwise(" "), x, F.lower(x)))
    parts = F.when(F.col("type") == "name", of_name).otherwise(F.array(part(F.lit(0), F.col("type"), F.lit(""), mention, plain)))
    pieces = checkpointed(each.select("key", "at", F.col("type").alias("kind"), F.explode(parts).alias("p")).select("key", "at", "kind", "p.*"))
    # A bare word is a mention of the person that a title of the same text names so; "last" is the greatest of the types.
    persons = pieces.where("kind = 'name'").groupBy("key", "canonical").agg(F.max("type").alias("_as"))
    words = pieces.where("kind = 'word'").join(persons, ["key", "canonical"], "left")
    bare = words.where("_as is not null").select("key", "at", F.lit("name").alias("kind"), "part", F.col("_as").alias("type"), "prefix", "shown", "canonical")
    entities = pieces.where("kind <> 'word'")
    subs = distinct_surrogates(checkpointed(entities.select("type", "canonical").distinct()), key)
    shown = entities.unionByName(bare).join(subs, ["type", "canonical"]).select("key", "at", "part", "kind", F.concat("prefix", dressed(F.col("type"), F.col("shown"), F.col("sub"))).alias("new"))
    shown = shown.unionByName(words.where("_as is null").select("key", "at", "part", "kind", F.col("shown").alias("new")))
    counts = F.transform(F.array_distinct("all_kinds"), lambda k: F.concat_ws(":", k, F.size(F.filter("all_kinds", lambda x: x == k)).cast("string")))
    listed = shown.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("at", "part", "new", "kind"))).alias("list"))
    listed = listed.withColumn("all_kinds", F.transform(F.filter("list", lambda x: (x["part"] == 0) & (x["kind"] != "word")), lambda x: x["kind"]))
    listed = listed.withColumn("kinds", F.array_join(F.array_sort(counts), ",")).withColumn("n_entities", F.size("all_kinds").cast("long"))
    # n + 1 pieces of text around n mentions.
    cut = bearing.select("key", "i", cut_at(lambda p: F.split("t", p, -1)).alias("around"))
    rebuilt = F.concat(
        F.array_join(F.transform("list", lambda x: F.concat(F.when(x["part"] == 0, F.element_at("around", x["at"] + 1)).otherwise(""), x["new"])), ""),
        F.element_at("around", -1),
    )
    changed = cut.join(listed, "key").select(F.col("i").alias(id), rebuilt.alias(text), "n_entities", "kinds")
    same = marked.where(F.size("mentions") == 0).select(F.col("i").alias(id), F.col("t").alias(text), F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    return same.unionByName(changed)
