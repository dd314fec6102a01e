"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Each distinct entity gets one surrogate for the whole corpus, made from a keyed hash so that
it has the type and format of what it stands for: digits for digits, case for case, valid
check digits and octets, names of the same gender and script. Rounds of collision checks make
sure that no two entities share a surrogate and that none is itself an entity of the corpus.
Where a format is used up, or has nothing to scramble, it is lengthened until all are settled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import _common as C

#: Titles of men, of women and of either; a name of one part (of a compound, after a particle or not), and a full name.
MEN = r"Mr\.?|Mister|Sir|Herrn?|Señor|Sr\.|Monsieur|г-н"
WOMEN = r"Mrs\.?|Ms\.?|Miss|Lady|Frau|Fräulein|Señora|Señorita|Sra\.|Madame|Mademoiselle|Mme\.?|Mlle\.?|г-жа"
EITHER = r"Dr\.?|Prof\.?|Doctor|Professor|Mx\.?|Docteur|Professeur|Доктор|Профессор"
NAME = r"(?:[ODLM]['’])?\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)*"
FULL = rf"(?:[A-Z]\. ?){{0,3}}{NAME}(?:-{NAME})*(?:(?: (?:[A-Z]\.|von|van|der|den|de|del|della|la|du|da|dos|di|zu|bin|al))* {NAME}(?:-{NAME})*){{0,3}}"
RANKS = rf"(?:(?:{EITHER}) )*"
#: Codes of countries, and numbers abroad and at home.
CODE = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
PHONES = (
    r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]?\d{4}\b",
    r"\+(?=(?:[ ().-]{0,2}\d){8})\d{1,3}(?:[ .-]{0,2}(?:\(\d{1,4}\)|\d{1,4})){2,6}\b",
    r"\(\d{3}\) ?\d{3}[ .-]\d{4}\b|\(0\d{1,4}\) ?\d{3,4}[ -]?\d{3,4}\b",
    r"\b(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}\b",
    r"\b0\d(?:[ .-]\d{2}){4}\b|\b0\d{2,4}[ -]\d{3,4} ?\d{3,4}\b|\b0\d{2,4}/\d{4,8}\b|\b0\d \d{4} \d{4}\b",
)
#: Type -> pattern. Fixed values; earlier types win.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": "|".join(PHONES),
    "access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "password": r"\bpassword=[^\s,;]{6,}",
    "secret": r"\b[0-9a-f]{32,64}\b",
    "ip": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
    "card": r"\b\d(?:[ -]?\d){12,15}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "person_m": rf"(?:\b|(?=г))(?:{MEN}) {RANKS}{FULL}",
    "person_f": rf"(?:\b|(?=г))(?:{WOMEN}) {RANKS}{FULL}",
    "person": rf"(?:\b|(?=[ДП]))(?:{EITHER}) {RANKS}{FULL}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What numbers of every type begin with: a digit, then at least five of their digits and separators.
_NUMBER = "[0-9][0-9 ()./-]{5}"
#: Type -> what each entity of it holds, and a cheap pattern for all: a text without any of these holds no entity.
HINTS = {"email": "@", "phone": _NUMBER, "access_key": "AKIA|ASIA", "password": "password=", "secret": "[0-9a-f]{32}", "ip": _NUMBER, "card": _NUMBER, "ssn": _NUMBER, "person_m": rf"(?:{MEN}) ", "person_f": rf"(?:{WOMEN}) ", "person": rf"(?:{EITHER}) "}
HINT = "|".join(dict.fromkeys(HINTS[kind] for kind in PATTERNS))

#: Stands around entities while a text is cut; texts that hold it are cut the slow way.
MARK = "\ue000\ue001\ue002"

#: Names by gender and script. Fixed values.
NAMES = {
    ("person_m", "latin"): "Adam Bruno Carl David Erik Felix Georg Henri Ivan Jonas Karl Louis Marco Nils Oskar Paul".split(),
    ("person_f", "latin"): "Anna Berta Clara Diana Elena Flora Greta Helen Irene Julia Karla Laura Maria Nora Olga Paula".split(),
    ("person_m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь".split(),
    ("person_f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина".split(),
}
NAMES |= {("person", script): NAMES["person_m", script] + NAMES["person_f", script] for script in ("latin", "cyrillic")}
_VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу"}
_CONSONANTS = {"latin": "bdklmnrst", "cyrillic": "бдклмнрст"}
#: Rounds of collision checks in an entity's own format, each leaves about the collisions' square; what is left then takes a longer one.
ROUNDS = 12


def kind_of(value: Column) -> Column:
    """The type of an entity that the patterns found."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(list(PATTERNS.items())):
        kind = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts).cast("binary"), 256)


def _below(digest: Column, n) -> Column:
    """A number below ``n`` from 48 bits of a digest."""
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n).cast("long"))


def _at(letters: str, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, letters)), (index + 1).cast("int"))


def _like(char: Column, digest: Column, hexadecimal: bool = False) -> Column:
    """A character of the same class."""
    lower = F.when(char.rlike("[a-f]"), _at("abcdef", _below(digest, 6))).otherwise(_at("abcdefghijklmnopqrstuvwxyz", _below(digest, 26))) if hexadecimal else _at("abcdefghijklmnopqrstuvwxyz", _below(digest, 26))
    return F.when(char.rlike("[0-9]"), _below(digest, 10).cast("string")).when(char.rlike("[a-z]"), lower).when(char.rlike("[A-Z]"), _at("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _below(digest, 26))).otherwise(char)


def _scrambled(text: Column, seed: Column, hexadecimal: bool = False) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: _like(c, F.sha2(F.concat_ws("\x1f", seed, i.cast("string")).cast("binary"), 256), hexadecimal)), "")


def _with_check_digit(digits: Column) -> Column:
    """Card digits (with separators) whose last digit is right by the Luhn rule."""
    plain = F.split(F.regexp_replace(digits, "[^0-9]", ""), "")
    body = F.reverse(F.slice(plain, F.lit(1), F.size(plain) - 1))
    doubled = F.transform(body, lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
    return F.concat(F.regexp_replace(digits, "[0-9]$", ""), F.pmod(-total, F.lit(10)).cast("string"))


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """What stands for an entity at an attempt: same type, same format."""
    seed = _digest(key, kind, value, attempt.cast("string"))
    nth = lambda i: F.sha2(F.concat_ws("\x1f", seed, F.lit("n"), F.lit(i).cast("string") if isinstance(i, int) else i.cast("string")).cast("binary"), 256)
    scrambled = _scrambled(value, seed)
    tld = F.regexp_extract(value, r"\.[A-Za-z]+$", 0)
    email = F.concat(_scrambled(F.regexp_replace(value, r"\.[A-Za-z]+$", ""), seed), tld)
    start = rf"^(?:{CODE}|0)"
    phone = F.concat(F.regexp_extract(value, start, 0), _scrambled(F.regexp_replace(value, start, ""), seed))
    octet = lambda o, i: F.when(F.length(o) == 1, _below(nth(i), 9) + 1).when(F.length(o) == 2, _below(nth(i), 90) + 10).otherwise(_below(nth(i), 155) + 100).cast("string")
    ip = F.array_join(F.transform(F.split(value, r"\."), octet), ".")
    access = F.concat(F.substring(value, 1, 4), F.array_join(F.transform(F.split(F.substring(value, 5, 16), ""), lambda c, i: _at("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", _below(nth(i), 32))), ""))
    password = F.concat(F.lit("password="), _scrambled(F.regexp_replace(value, "^password=", ""), seed, True))
    card = _with_check_digit(F.concat(F.substring(value, 1, 1), _scrambled(F.regexp_replace(value, "^.", ""), seed)))
    title = F.regexp_extract(value, r"^\S+ ", 0)

    # Beyond the rounds each attempt adds some 40 bits, so that every entity settles however full its format is.
    late = F.greatest(attempt - ROUNDS + 1, F.lit(0))
    longer = lambda letters, width: F.when(late > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(late, F.lit(1)) * width), lambda i: _at(letters, _below(nth(i + 2000), len(letters)))), "")).otherwise("")
    letters, capitals, digits = longer("abcdefghijklmnopqrstuvwxyz", 9), longer("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 9), longer("0123456789", 12)
    wide = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_below(nth(i), 155) + 100).cast("string")), ".")
    groups = F.concat(F.lit("2001:db8"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.lit(":"), F.substring(nth(i), 1, 4))), ""))
    ip = F.when(late == 0, ip).when(late <= ROUNDS, wide).otherwise(groups)
    email, phone = F.concat(letters, email), F.concat(phone, digits)
    access, password, secret = F.concat(access, capitals), F.concat(password, letters), F.concat(_scrambled(value, seed, True), longer("0123456789abcdef", 10))
    card = F.when(late == 0, card).otherwise(_with_check_digit(F.concat(card, digits)))
    scrambled = F.concat(scrambled, F.when((late > 0) & (kind == "ssn"), F.concat(F.lit("-"), digits)).otherwise(letters))

    def name(gender: str) -> Column:
        def of(script: str) -> Column:
            names = NAMES[gender, script]
            # Later attempts lengthen the name, so that there are always more names than people.
            more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda i: F.concat(_at(_CONSONANTS[script], _below(nth(i), len(_CONSONANTS[script]))), _at(_VOWELS[script], _below(nth(i + 1000), 5)))), "")
            first = F.element_at(F.array(*map(F.lit, names)), (_below(nth(0), len(names)) + 1).cast("int"))
            return F.concat(title, first, F.when(attempt > 0, more).otherwise(""))

        return F.when(value.rlike(r"\p{IsCyrillic}+$"), of("cyrillic")).otherwise(of("latin"))

    return (
        F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "access_key", access).when(kind == "password", password)
        .when(kind == "secret", secret).when(kind == "card", card).when(kind == "person_m", name("person_m")).when(kind == "person_f", name("person_f")).when(kind == "person", name("person")).otherwise(scrambled)
    )


def surrogates(values: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate), distinct throughout, for distinct ``values`` (kind, value)."""
    values = C.cut(values, per_core=1)
    originals = values.select(F.col("value").alias("surrogate")).distinct()
    # A password of marks or of letters beyond ASCII has nothing to scramble.
    fixed = (F.col("kind") == "password") & ~F.col("value").rlike("=.*[A-Za-z0-9]")
    done, rest = None, values.withColumn("attempt", F.when(fixed, ROUNDS).otherwise(0))
    while True:
        made = rest.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key))
        # The first entity of a surrogate keeps it, unless the corpus or an earlier round holds it.
        winner = made.groupBy("surrogate").agg(F.min(F.struct("value", "kind")).alias("w")).select("surrogate", "w.value", "w.kind").join(originals, "surrogate", "left_anti")
        if done is not None:
            winner = winner.join(done.select("surrogate"), "surrogate", "left_anti")
        settled = C.cut(made.join(winner, ["surrogate", "value", "kind"], "left_semi").select("kind", "value", "surrogate"), per_core=1)
        rest = C.cut(rest.join(settled.select("kind", "value"), ["kind", "value"], "left_anti").withColumn("attempt", F.col("attempt") + 1), per_core=1)
        done = settled if done is None else done.unionByName(settled)
        if rest.isEmpty():
            return done


def parts_of(kind: Column, value: Column) -> Column:
    """The entities of a mention: the names of a person without title and marks, the digits of a number, else the mention."""
    bare = F.regexp_replace(value, rf"^(?:(?:{MEN}|{WOMEN}|{EITHER}) )+", "")
    names = F.array_distinct(F.regexp_extract_all(bare, F.lit(NAME), F.lit(0)))
    return F.when(kind.startswith("person"), names).when(kind.isin("phone", "card"), F.array(F.regexp_replace(value, "[^0-9+]", ""))).otherwise(F.array(value))


def rendered(kind: Column, value: Column, map_: Column) -> Column:
    """A mention with the surrogates of its parts, in its own layout."""
    title = F.regexp_extract(value, rf"^(?:(?:{MEN}|{WOMEN}|{EITHER}) )+", 0)
    bare = F.substr(value, F.length(title) + 1)
    found = F.regexp_extract_all(bare, F.lit(NAME), F.lit(0))
    person = F.concat(title, F.array_join(F.zip_with(F.split(bare, NAME, -1), F.transform(found, lambda n: F.element_at(map_, n)), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))
    digits = F.regexp_replace(F.element_at(F.map_values(map_), 1), "[^0-9]", "")
    at = lambda i: F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), "[^0-9]", ""))
    laid = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digits, at(i), F.lit(1))).otherwise(c)), "")
    number = F.concat(laid, F.substr(digits, F.length(F.regexp_replace(value, "[^0-9]", "")) + 1))
    return F.when(kind.startswith("person"), person).when(kind.isin("phone", "card"), number).otherwise(F.element_at(F.map_values(map_), 1))


def replace_entities(docs: DataFrame, key: str, counts: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) with surrogates for entities; with ``counts`` also n_entities and kinds.

    Equal entities have equal surrogates in all rows, different ones different surrogates: a number
    whatever its separators, each name of a person whatever its title's form. Names that a text
    has with a title are replaced in it without one, too; ``n_entities`` doesn't count these.
    Null and empty texts and texts without entities stay. Repeated rows give repeated results.
    ``n_chars``, where there is such a column, follows the text.
    """
    names = docs.columns
    own = docs.select(*(F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(names)), F.col("text"))
    # One search cuts a text into what is between entities and, at odd places, the entities.
    parts = F.split(F.regexp_replace("text", f"({ANY})", rf"{MARK}$1{MARK}"), MARK, -1)
    twice = F.flatten(F.zip_with(F.split("text", ANY, -1), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), lambda a, b: F.array_compact(F.array(a, b))))
    parts = F.when(F.col("text").rlike(HINT), F.when(F.col("text").contains(MARK), twice).otherwise(parts))
    has = F.coalesce(F.size(parts) > 1, F.lit(False))
    # The row's number in the same projection keeps the filter above it, so that the search runs once.
    held = own.withColumns({"parts": parts, "row_key": F.monotonically_increasing_id()}).where(F.size("parts") > 1).drop("text", f"own_{names.index('text')}")
    held = C.cut(held.withColumn("entities", F.filter("parts", lambda x, i: i % 2 == 1)))
    seen = held.select("row_key", F.explode(F.array_distinct("entities")).alias("value"))
    values = C.cut(seen.groupBy("value").agg(F.count("*").alias("k")).withColumn("kind", F.coalesce(kind_of(F.col("value")), F.lit("other"))), per_core=1)
    of_value = C.cut(values.select("kind", "value", "k", F.explode(parts_of(F.col("kind"), F.col("value"))).alias("part")), per_core=1)
    each = C.cut(of_value.groupBy("kind", F.col("part").alias("value")).agg(F.count("*").alias("n")), per_core=1)
    known = surrogates(each.select("kind", "value"), key).select("kind", F.col("value").alias("part"), F.col("surrogate").alias("own"))
    pair = F.struct("part", "own")
    # A name may be a part of very many full names, and a value may be in very many texts.
    mapped = C.hot_join(of_value, known, ["kind", "part"], "n", "value", counts=each.withColumnRenamed("value", "part")).groupBy("kind", "value", "k").agg(F.map_from_entries(F.collect_list(pair)).alias("m"), F.collect_list(F.when(F.col("kind").startswith("person"), pair)).alias("people"))
    mentions = C.cut(mapped.select("kind", "value", "k", rendered(F.col("kind"), F.col("value"), F.col("m")).alias("surrogate"), "people"), per_core=1)
    maps = C.hot_join(seen, mentions, "value", "k", "row_key").groupBy("row_key").agg(F.map_from_entries(F.collect_list(F.struct("value", "surrogate"))).alias("map"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("people")))).alias("people"))
    joined = held.join(maps, "row_key")
    bare = lambda text: F.aggregate("people", text, lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{M}])"), p["part"], F.lit(r"(?![\p{L}\p{M}])")), p["own"]))
    pieces = F.transform("parts", lambda x, i: F.when(i % 2 == 1, F.coalesce(F.try_element_at("map", x), F.lit(""))).when(F.size("people") > 0, bare(x)).otherwise(x))
    changed = joined.withColumn("new_text", F.array_join(pieces, "")).withColumn("n_entities", F.size("entities").cast("long"))
    plain = own.where(~has).withColumns({"new_text": F.col("text"), "n_entities": F.lit(0).cast("long"), "kinds": F.lit("")})
    columns = [(F.col("new_text") if c == "text" else F.length("new_text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"own_{k}")).alias(c) for k, c in enumerate(names)]
    columns += [F.col("n_entities"), F.col("kinds")] if counts else []
    return changed.select(*columns).unionByName(plain.select(*columns))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_entities, kinds, text) of every row of ``documents``; see ``replace_entities``."""
    return replace_entities(C.pick(C.table(spark, sf_dir, "documents"), "doc_id", "text"), key="ledgerloom", counts=True).select("doc_id", "n_entities", "kinds", "text")
