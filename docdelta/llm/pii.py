"""Operator 3: surrogate generation for personal data, in DataFrame functions only.

Entities are found by patterns, and people's names again wherever their words recur in a text that names them. Each
distinct entity gets a replacement drawn by a key: of its kind, length and script, written the way each mention is
written. A person's given names and surname are entities of their own, so that a full name and a surname alone agree;
given names follow the gender. Replacements that equal another's, or an entity of the corpus, are drawn again, from a
larger space each time, so that different entities stay different and one entity is the same everywhere.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import column
from .storage import discard, materialise

#: Forms of address by gender, words that introduce a name, given names by script and gender.
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Господин", "Κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"]
OTHER_TITLES = ["Dr", "Prof"]
CUES = ["[Mm]y name is", "[Cc]ontact", "[Dd]ear", "[Ss]igned by", "[Nn]ame:", "[Aa]ttn:", "[Ii]ch heiße", "[Jj]e m'appelle", "[Mm]e llamo", "[Mm]eine? Name ist"]
NAMES = {
    ("latin", "m"): ["Adrian", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Gabriel", "Henry", "Ivan", "Jonas", "Kevin", "Leon", "Martin", "Noah", "Oscar", "Paul"],
    ("latin", "f"): ["Alice", "Bianca", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olivia", "Paula"],
    ("cyrillic", "m"): ["Алексей", "Борис", "Виктор", "Георгий", "Денис", "Егор", "Иван", "Кирилл"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Ксения", "Лариса"],
    ("greek", "m"): ["Αλέξανδρος", "Γιώργος", "Δημήτρης", "Κώστας", "Μιχάλης", "Νίκος", "Πέτρος", "Σταύρος"],
    ("greek", "f"): ["Άννα", "Βασιλική", "Δήμητρα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"],
}
#: More given names, found without a form of address if another capitalised word follows.
MORE_NAMES = {
    "m": ["John", "James", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Peter", "Andrew", "George", "Edward", "Hans", "Klaus", "Jürgen", "Wolfgang", "Stefan", "Jean", "Pierre", "Jacques", "Michel", "Juan", "José", "Carlos", "Luis", "Pedro", "Miguel"],
    "f": ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Anna", "Emma", "Jane", "Margaret", "Ursula", "Sabine", "Monika", "Petra", "Marie", "Sophie", "Camille", "Isabelle", "Carmen", "Lucía", "Sofía", "Teresa", "Ana"],
}
#: Syllables of surnames by script, and the endings of made-up given names and of gendered surnames.
SYLLABLES = {
    "latin": ["bar", "den", "fol", "gar", "han", "jor", "kel", "lin", "mar", "nor", "pel", "rin", "sal", "tor", "vel", "wen"],
    "cyrillic": ["бар", "ден", "фол", "гар", "хан", "жор", "кел", "лин", "мар", "нор", "пел", "рин", "сал", "тор", "вел", "зен"],
    "greek": ["βαρ", "δεν", "φολ", "γαρ", "χαν", "ζορ", "κελ", "λιν", "μαρ", "νορ", "πελ", "ριν", "σαλ", "τορ", "βελ", "ξεν"],
}
ENDINGS = {"latin": {"m": "o", "f": "a"}, "cyrillic": {"m": "ан", "f": "а"}, "greek": {"m": "ος", "f": "η"}}
SURNAME_ENDINGS = {"cyrillic": {"m": "ов", "f": "ова"}, "greek": {"m": "ίδης", "f": "ίδου"}}
FEMALE_SURNAME = {"cyrillic": "[ая]$", "greek": "(?:ου|α|η|ή|ά)$"}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLE = "(?:" + "|".join([*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES]) + ")"
_GIVEN = "(?:" + "|".join([*(n for names in NAMES.values() for n in names), *MORE_NAMES["m"], *MORE_NAMES["f"]]) + ")"
_CUE = "(?:" + "|".join(CUES) + ")"
_WORD = r"\p{Lu}\p{L}+"
_EDGE = r"(?<![\p{L}\p{N}])"
#: What stands before a name and stays: up to three forms of address, or a cue that no form of address follows.
_BEFORE_NAME = rf"(?:(?:{_TITLE}\.? ){{1,3}}+|{_CUE} (?!{_TITLE}\b))"
#: Kind → pattern; a text is searched for all at once, the first in this order at a place wins. Repeated groups are
#: bounded (a domain has at most 127 labels), since the search recurses once for each repetition.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?<!\.)@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9.-])(?:\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{13,19})(?![A-Za-z0-9]|[.-]\d)",
    "phone": r"(?<![A-Za-z0-9+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-. ]\d{4}(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9-])",
    "ip": rf"(?<![A-Za-z0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![A-Za-z0-9]|\.\d)|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}(?![0-9A-Fa-f:])",
    "name": rf"{_EDGE}(?:(?:{_TITLE}\.? ){{1,3}}+{_WORD}(?:[ -]{_WORD}){{0,2}}|{_CUE} (?!{_TITLE}\b){_WORD}(?:[ -]{_WORD}){{1,2}}|{_GIVEN}(?:[ -]{_WORD}){{1,2}})(?!\p{{L}})",
}
_ALL = "|".join(PATTERNS.values())
#: Texts that name somebody are searched for single capitalised words too, which may be the names again.
_WIDE = rf"{_ALL}|{_EDGE}{_WORD}(?![\p{{L}}\p{{N}}@_%+]|[.-][A-Za-z0-9._%+-]*+@)"
#: Texts without any of these hold no entity: a digit or an at sign; what a name begins with.
_HINTS = ("[0-9@]", rf"{_EDGE}(?=[\p{{Lu}}mcdsnaij])(?:(?:{_TITLE}\.?|{_CUE}|{_GIVEN}-?) ?\p{{Lu}})")
#: An address that is drawn again so often leaves its format: an IPv4 address becomes an IPv6 one.
SAME_FORM = 8


def _text(value: Column) -> Column:
    return value.cast("string")


def _prefix(mention: Column) -> Column:
    return F.regexp_extract(mention, f"^({_BEFORE_NAME})", 1)


def _bare(mention: Column) -> Column:
    return F.substr(mention, F.length(_prefix(mention)) + 1)


def _is_name(mention: Column) -> Column:
    """Of mentions, those of names are the only ones of letters alone."""
    return ~F.rlike(mention, F.lit("[0-9@]|(?:[0-9A-Fa-f]{1,4}:){7}"))


def mentions(text: Column) -> Column:
    """All mentions of a text in order; if some are names, its capitalised words as well."""
    hint = reduce(lambda a, b: a | b, (F.rlike(text, F.lit(h)) for h in _HINTS))
    found = F.when(hint, F.regexp_extract_all(text, F.lit(_ALL), F.lit(0))).otherwise(F.array().cast("array<string>"))
    wider = F.transform(F.array(found), lambda m: F.when(F.exists(m, _is_name), F.regexp_extract_all(text, F.lit(_WIDE), F.lit(0))).otherwise(m))
    return F.element_at(wider, 1)


def _kind(mention: Column) -> Column:
    """The kind of a mention: ``word`` for a lone capitalised word, which may be a name or not."""
    others = [k for k in PATTERNS if k != "name"]
    name = F.when(F.rlike(mention, F.lit(f"^{_WORD}$")), "word").otherwise("name")
    return reduce(lambda rest, k: F.when(F.rlike(mention, F.lit(f"^(?:{PATTERNS[k]})$")), F.lit(k)).otherwise(rest), reversed(others), name)


def _canonical(kind: Column, mention: Column) -> Column:
    """What mentions of one entity have in common: digits and letters alone, in lower case; e-mail and IP as they are."""
    return F.when(kind.isin("email", "ip", "word"), F.lower(mention)).otherwise(F.lower(F.regexp_replace(mention, r"[^\p{L}\p{N}]", "")))


def _gender(mention: Column) -> Column:
    """m or f by the last form of address that tells, else by the first given name; else empty."""
    titles = F.regexp_extract_all(_prefix(mention), F.lit(_TITLE + r"(?!\p{L})"), F.lit(0))
    told = lambda some: F.exists(titles, lambda t: t.isin(some))
    first = F.regexp_extract(_bare(mention), r"^(\p{L}+)[ -]", 1)
    given = {g: [*(n for (_, sex), names in NAMES.items() if sex == g for n in names), *MORE_NAMES[g]] for g in "mf"}
    return F.when(told(MALE_TITLES), "m").when(told(FEMALE_TITLES), "f").when(first.isin(given["m"]), "m").when(first.isin(given["f"]), "f").otherwise("")


def _script(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.rlike(text, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")


def _stream(key: str, *seed: Column) -> Column:
    """Hexadecimal digits that nobody can tell without the key."""
    part = lambda k: F.sha2(F.concat_ws("\x1f", F.lit(key), *seed, F.lit(k)), 512)
    return F.concat(part("1"), part("2"))


def _number(stream: Column, at: Column) -> Column:
    """The at-th number below 65536 of a stream, around and around."""
    return F.conv(F.substr(stream, F.pmod(at, F.lit(64)) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(number, F.lit(len(values))).cast("int") + 1)


def _letter(code: Column, base: str, size: int) -> Column:
    return F.char(F.pmod(code, F.lit(size)) + ord(base))


def _luhn(digits: Column) -> Column:
    """Sum of Luhn's rule over a string of digits, its last one being the check digit."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    parts = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c.isin(list("0123456789")), F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))).otherwise(0))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def _draw_part(kind: Column, entity: Column, stream: Column, attempt: int) -> Column:
    """A word of a name. Surnames have a syllable more with each attempt; given names come from the list twice, then
    from syllables. The endings keep given names of the two genders apart."""
    script = _script(entity)

    def of(s: str) -> Column:
        made = lambda n: F.concat(*(_pick(SYLLABLES[s], _number(stream, F.lit(2 + k))) for k in range(n)))
        ends = SURNAME_ENDINGS.get(s)
        surname = F.concat(made(3 + attempt), F.when(F.rlike(entity, F.lit(FEMALE_SURNAME[s])), ends["f"]).otherwise(ends["m"])) if ends else made(3 + attempt)
        given = lambda g: F.lower(_pick(NAMES[s, g], _number(stream, F.lit(1)))) if attempt < 2 else F.concat(made(attempt), F.lit(ENDINGS[s][g]))
        return F.when(kind == "surname", surname).when(kind == "given_m", given("m")).otherwise(given("f"))

    return F.when(script == "cyrillic", of("cyrillic")).when(script == "greek", of("greek")).otherwise(of("latin"))


def _draw(kind: Column, entity: Column, attempt: int, key: str) -> Column:
    """The surrogate of a canonical entity at an attempt: the same places of letters, digits and signs. From the third
    attempt on it has a character more each time: letters before an e-mail's, digits after the others'."""
    stream = _stream(key, kind, entity, F.lit(str(attempt)))
    more = max(attempt - 1, 0)
    form = F.when(kind == "email", F.concat(F.lit("a" * more), entity)).when(kind == "ip", F.lit("0a0a:" * 7 + "0a0a") if more else entity).otherwise(F.concat(entity, F.lit("0" * more)))
    tail = F.length(form) - F.length(F.regexp_extract(entity, r"(\.[a-z]{2,})$", 1))  # an e-mail's last label stays
    head = F.when(kind == "iban", 2).when(kind == "card", 1).when(kind == "phone", F.greatest(F.length(entity) - 10, F.lit(0))).otherwise(0)

    def one(c: Column, i: Column) -> Column:
        n = _number(stream, i)
        keep = (i < head) | ((kind == "email") & (i >= tail))
        return F.when(keep, c).when(c.isin(list("123456789")), _letter(n, "1", 9)).when(c == "0", _letter(n, "0", 10)).when((c >= "a") & (c <= "z"), F.when(kind == "ip", _letter(n, "a", 6)).otherwise(_letter(n, "a", 26))).otherwise(c)

    mapped = F.array_join(F.transform(F.split(form, ""), one), "")
    body = F.substr(mapped, F.lit(1), F.length(mapped) - 1)
    check = F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    card = F.when(F.pmod(_luhn(entity), F.lit(10)) == 0, F.concat(body, check)).otherwise(mapped)
    octets = F.array_join(F.transform(F.split(entity, r"\."), lambda o, i: (F.pmod(_number(stream, i), F.lit(254)) + 1).cast("string")), ".")
    out = F.when(kind == "card", card).when(kind.isin("surname", "given_m", "given_f"), _draw_part(kind, entity, stream, attempt))
    return (out if attempt >= SAME_FORM else out.when((kind == "ip") & F.contains(entity, F.lit(".")), octets)).otherwise(mapped)


def _write(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's own writing: its capitals, blanks and signs."""
    letters = F.split(surrogate, "")

    def step(a: Column, c: Column) -> Column:
        s = F.coalesce(F.get(letters, a["at"]), F.lit(""))
        used = F.rlike(c, F.lit(r"[\p{L}\p{N}]"))
        put = F.when(used, F.when(F.rlike(c, F.lit(r"\p{Lu}")), F.upper(s)).otherwise(s)).otherwise(c)
        return F.struct((a["at"] + F.when(used, 1).otherwise(0)).alias("at"), F.concat(a["out"], put).alias("out"))

    filled = F.aggregate(F.split(mention, ""), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substr(surrogate, a["at"] + 1)))
    surplus = F.length(surrogate) - F.length(mention)
    cased = F.transform(F.split(mention, ""), lambda c, i: F.when(F.rlike(c, F.lit("[A-Z]")), F.upper(F.get(letters, i + surplus))).otherwise(F.get(letters, i + surplus)))
    email = F.concat(F.substr(surrogate, F.lit(1), surplus), F.array_join(cased, ""))
    name = F.when((F.upper(mention) == mention) & (F.length(mention) > 1), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    ip = F.when(F.rlike(mention, F.lit("[A-F]")), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("surname", "given_m", "given_f"), name).when(kind == "ip", ip).when(kind == "email", email).otherwise(filled)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) for distinct (kind, entity), without collisions.

    A draw stands if it is no entity of its kind (given names: not the name itself, for a surname that is nobody's
    follows them) and no other entity holds it, the smallest of equal draws winning; the rest draw again, from a space
    that grows with every attempt, until none waits.
    """
    kept: list[str] = []

    def write(table: DataFrame, name: str) -> DataFrame:
        out, path = materialise(table, name)
        kept.append(path)
        return out

    waiting = write(entities.select("kind", "entity"), "entities")
    originals = waiting.where("kind not in ('given_m', 'given_f')").select("kind", F.col("entity").alias("surrogate"))
    done: DataFrame | None = None
    for attempt in itertools.count():
        drawn = waiting.withColumn("surrogate", _draw(F.col("kind"), F.col("entity"), attempt, key)).where("surrogate <> entity")
        free = drawn.join(originals, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = write(free.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity")).select("kind", "entity", "surrogate"), "surrogates")
        done = won if done is None else done.unionByName(won)
        waiting = write(waiting.join(won, ["kind", "entity"], "left_anti"), "entities")
        if waiting.isEmpty():
            break
    out, _ = materialise(done, "surrogates")
    for path in kept:
        discard(entities.sparkSession, path)
    return out


def _parts(placed: DataFrame, key: str) -> DataFrame:
    """(key, pos, i, lead, piece, kind, entity): the mentions of texts (key, pos, mention) in the pieces that are replaced
    one by one: words of names, whole mentions otherwise. ``lead`` stands before a piece and stays. ``kind`` is null
    for capitalised words that are no name in their text.

    The gender of a full name is told by its mentions in the text, else in the corpus; where these say both or
    nothing, the key decides, the same way for the name everywhere.
    """
    rows = placed.withColumn("kind", _kind(F.col("mention")))
    whole = rows.where("kind <> 'name'").select("key", "pos", F.lit(0).alias("i"), F.lit("").alias("lead"), F.col("mention").alias("piece"), F.nullif("kind", F.lit("word")).alias("kind"), _canonical(F.col("kind"), F.col("mention")).alias("entity"))
    names = rows.where("kind = 'name'").select("key", "pos", _prefix(F.col("mention")).alias("prefix"), _bare(F.col("mention")).alias("bare"), F.nullif(_gender(F.col("mention")), F.lit("")).alias("own"))
    names = names.withColumn("full", F.lower("bare"))
    here = Window.partitionBy("key", "full")
    names = names.withColumns({"low": F.min("own").over(here), "high": F.max("own").over(here)})
    corpus = names.groupBy("full").agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least = most").select("full", "most")
    coin = F.when(_number(_stream(key, F.lit("gender"), F.col("full")), F.lit(0)) % 2 == 0, "m").otherwise("f")
    gender = F.coalesce("own", F.when(F.col("low") == F.col("high"), F.col("low")), "most", coin)
    told = names.join(corpus, "full", "left").withColumn("gender", gender)
    words = F.split("bare", "[ -]", -1)
    signs = F.regexp_extract_all("bare", F.lit("[ -]"), F.lit(0))
    last = F.size(words) - F.size(F.split(F.substring_index("bare", " ", -1), "-", -1))  # the words of the last group are surnames
    pieces = F.transform(words, lambda w, i: F.struct(
        i.alias("i"), F.when(i == 0, F.col("prefix")).otherwise(F.get(signs, i - 1)).alias("lead"), w.alias("piece"),
        F.when(i >= last, "surname").otherwise(F.concat(F.lit("given_"), F.col("gender"))).alias("kind"), F.lower(w).alias("entity"),
    ))
    every = whole.unionByName(told.select("key", "pos", F.inline(pieces)))
    again = F.max(F.when(F.col("kind").isin("surname", "given_m", "given_f"), F.col("kind"))).over(Window.partitionBy("key", "entity"))
    return every.withColumn("kind", F.coalesce("kind", again))


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` with every entity in ``text_col`` replaced; with ``count_col`` the number of mentions.

    Other columns pass through, whatever their names. A null text stays null (0 mentions), a text without entities
    stays as it is; what has no ending within 127 labels is no e-mail address; repeated rows are kept; an empty table
    gives no rows. Whole texts are searched, in time that grows with their length. Names are found after a form of
    address or a cue, or by a common given name, and then wherever their words stand alone in the same text. The same
    key gives the same surrogates for the same set of entities; a format too small for its entities gets longer ones.

    Texts are searched once, in the pass that writes the rows with their mentions; those that have some are shuffled,
    exact copies as one text until the last join, in which Spark can split a text that many rows have.
    """
    if not key:
        raise ValueError("surrogates need a key")
    columns = docs.columns
    spark = docs.sparkSession
    rows = docs.select(F.struct(*(column(c).alias(f"c{k}") for k, c in enumerate(columns))).alias("row"), mentions(_text(column(text_col))).alias("found"))
    rows, _ = materialise(rows.withColumn("hit", F.coalesce(F.size("found") > 0, F.lit(False))), "mentions", "hit")
    text = _text(F.col("row")[f"c{columns.index(text_col)}"])
    changed = rows.where("hit").withColumn("key", F.sha2(text, 256))
    placed = changed.groupBy("key").agg(F.first("found").alias("found")).select("key", F.posexplode("found").alias("pos", "mention"))
    parts, parts_path = materialise(_parts(placed, key), "parts")
    surrogates = assign(parts.where("kind is not null").select("kind", "entity").distinct(), key)
    written = parts.join(surrogates, ["kind", "entity"], "left").select("key", "pos", "i", F.col("surrogate").isNotNull().alias("new"), F.concat("lead", F.coalesce(_write(F.col("kind"), F.col("piece"), F.col("surrogate")), "piece")).alias("put"))
    whole = written.groupBy("key", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "put"))), lambda p: p["put"]), "").alias("put"), F.bool_or("new").alias("new"))
    per_text, _ = materialise(whole.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "put"))), lambda p: p["put"]).alias("puts"), F.count_if("new").alias("n")), "texts")
    discard(spark, parts_path)
    pieces = F.when(F.exists("found", _is_name), F.split(text, _WIDE, -1)).otherwise(F.split(text, _ALL, -1))
    new = F.array_join(F.zip_with(pieces, F.col("puts"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    def out(value: Column, n: Column) -> list[Column]:
        kept = [(value if c == text_col else F.col("row")[f"c{k}"]).alias(c) for k, c in enumerate(columns)]
        return [*kept, n.cast("bigint").alias(count_col)] if count_col else kept

    return changed.join(per_text, "key").select(*out(new, F.col("n"))).unionByName(rows.where("not hit").select(*out(F.col("row")[f"c{columns.index(text_col)}"], F.lit(0))))
