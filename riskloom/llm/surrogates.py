"""Surrogates for personal data, with DataFrame functions only.

Entities are found by one pattern. Each distinct entity gets one surrogate from a
keyed digest of its type and value, so every mention in the corpus is replaced
alike. A surrogate keeps the shape of its entity: digits for digits, letters for
letters of the same case and script, and the same separators; card numbers stay
valid under their check digit, names keep gender and script. Surrogates that
collide with each other or with an entity of the corpus are drawn again until all
are distinct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.shared import stored

# Common given names by gender and script, and titles that tell a gender.
FEMALE = ("Alice", "Anna", "Carla", "Clara", "Elena", "Emma", "Eva", "Greta", "Helen", "Ingrid", "Julia", "Laura", "Lena",
          "Lucia", "Maria", "Marta", "Nina", "Olivia", "Paula", "Sophie")
MALE = ("Albert", "Anton", "Bruno", "Carlos", "David", "Emil", "Felix", "Georg", "Henry", "Hugo", "Jakob", "James", "Karl",
        "Leon", "Louis", "Martin", "Oscar", "Pablo", "Robert", "Thomas")
FEMALE_CYRILLIC = ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья")
MALE_CYRILLIC = ("Андрей", "Борис", "Иван", "Игорь", "Михаил", "Николай", "Павел", "Сергей")
FAMILY = ("Adler", "Becker", "Castro", "Dubois", "Evans", "Fischer", "Garcia", "Hansen", "Ivers", "Jansen", "Keller",
          "Lambert", "Moreau", "Navarro", "Olsen", "Peters", "Quint", "Romero", "Schmidt", "Turner")
FAMILY_CYRILLIC = ("Белов", "Волков", "Громов", "Егоров", "Зайцев", "Козлов", "Морозов", "Соколов")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr")
NEUTRAL_TITLES = ("Dr", "Prof")

_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# An address has at most 254 characters and 127 labels; the bounds keep long tokens linear and off the stack.
_EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,254}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,}"
_IP = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"
_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_PHONE = r"(?<!\w)(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?!\w)|(?<![\w-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
_CARD = r"(?<![\w-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])"
_IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
_TITLES = "|".join((*FEMALE_TITLES, *MALE_TITLES, *NEUTRAL_TITLES))
_CAPITAL = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_NAME = rf"(?<!\p{{L}})(?:{_TITLES})\.? {_CAPITAL}(?: {_CAPITAL})?"
KINDS = {"email": _EMAIL, "iban": _IBAN, "ssn": _SSN, "phone": _PHONE, "card": _CARD, "ip": _IP, "name": _NAME}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())


@dataclass(frozen=True)
class SurrogateParams:
    """``secret`` keys the digests: with another one all surrogates change. ``rounds`` bounds the redraws for
    collisions; if any are left after them an error is raised, none is passed on.
    """

    secret: str = "change-me"
    rounds: int = 20


def mentions(text: Column) -> Column:
    """All entity mentions of a text in order, as an array; empty for null.

    Every kind needs a digit, an @ or a title, which is much cheaper to look for.
    """
    none = F.array().cast("array<string>")
    return F.when(text.rlike(rf"[0-9@]|(?:{_TITLES})\.? "), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)


def entity_kind(value: Column) -> Column:
    kind = F.lit("name")
    for name, pattern in reversed(list(KINDS.items())[:-1]):
        kind = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


def _stream(secret: str, kind: Column, value: Column, turn: Column) -> Column:
    """256 hex digits from the key, the entity and the number of the draw."""
    parts = [F.sha2(F.concat_ws("\x1f", F.lit(secret), kind, value, turn.cast("string"), F.lit(str(i))), 256) for i in range(4)]
    return F.concat(*parts)


def _byte(stream: Column, i: Column) -> Column:
    """Number from 0 to 65535 at place i of the stream (it repeats after 63 places)."""
    return F.conv(F.substring(stream, i % 63 * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _like(stream: Column, value: Column, keep: Column) -> Column:
    """``value`` with every digit and Latin letter drawn anew, but where ``keep(i)`` holds."""

    def draw(c: Column, i: Column) -> Column:
        n = _byte(stream, i)
        pick = lambda letters: F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))
        return (
            F.when(keep(i, c), c)
            .when(c.rlike("[0-9]"), pick(_DIGIT))
            .when(c.rlike("[a-z]"), pick(_LOWER))
            .when(c.rlike("[A-Z]"), pick(_UPPER))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), draw), "")


def _luhn_fixed(number: Column) -> Column:
    """A number with its last digit set so that the check sum holds; separators stay."""
    digits = F.reverse(F.split(F.regexp_replace(number, "[^0-9]", ""), ""))

    def part(c: Column, i: Column) -> Column:
        n = c.cast("int")
        twice = F.when(n * 2 > 9, n * 2 - 9).otherwise(n * 2)
        return F.when(i == 0, F.lit(0)).when(i % 2 == 1, twice).otherwise(n)

    total = F.aggregate(F.transform(digits, part), F.lit(0), lambda a, x: a + x)
    return F.concat(F.regexp_replace(number, r"\d(?=\D*$)", ""), ((10 - total % 10) % 10).cast("string"))


def _pick(stream: Column, i: int, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), _byte(stream, F.lit(i)) % len(names) + 1)


def _name(stream: Column, value: Column) -> Column:
    """Title kept; given name by the title's gender (a known given name tells it too), family name, script kept."""
    title = F.regexp_extract(value, rf"^({_TITLES})\.? ", 0)
    rest = F.split(F.substring(value, F.char_length(title) + 1, F.char_length(value)), " ")
    bare = F.regexp_replace(title, r"[. ]", "")
    first = F.element_at(rest, 1)
    female = bare.isin(*FEMALE_TITLES) | (~bare.isin(*MALE_TITLES) & first.isin(*FEMALE, *FEMALE_CYRILLIC))
    male = bare.isin(*MALE_TITLES) | (~bare.isin(*FEMALE_TITLES) & first.isin(*MALE, *MALE_CYRILLIC))
    cyrillic = value.rlike(r"\p{IsCyrillic}")

    def given(latin: tuple[str, ...], other: tuple[str, ...]) -> Column:
        return F.when(cyrillic, _pick(stream, 0, other)).otherwise(_pick(stream, 0, latin))

    own = (
        F.when(female, given(FEMALE, FEMALE_CYRILLIC))
        .when(male, given(MALE, MALE_CYRILLIC))
        .otherwise(given(FEMALE + MALE, FEMALE_CYRILLIC + MALE_CYRILLIC))
    )
    family = F.when(cyrillic, _pick(stream, 1, FAMILY_CYRILLIC)).otherwise(_pick(stream, 1, FAMILY))
    # A drawn ending keeps the space of family names large enough for any number of entities.
    tail = F.concat(*[F.substring(F.lit("aeiou" if i % 2 else "bdklmnrst"), _byte(stream, F.lit(i + 2)) % (5 if i % 2 else 9) + 1, F.lit(1)) for i in range(6)])
    cyrillic_tail = F.translate(tail, "aeioubdklmnrst", "аеиоубдклмнрст")
    family = F.concat(family, F.when(cyrillic, cyrillic_tail).otherwise(tail))
    return F.concat(title, F.when(F.size(rest) > 1, F.concat_ws(" ", own, family)).otherwise(family))


def _surrogate(secret: str, kind: Column, value: Column, turn: Column) -> Column:
    stream = _stream(secret, kind, value, turn)
    never = lambda i, c: F.lit(False)
    country = F.length(F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])", 0))
    at = F.instr(value, "@")
    domain = F.concat(F.lit("@mail"), (_byte(stream, F.lit(40)) % 10_000).cast("string"), F.lit(".example."), F.regexp_extract(value, r"[A-Za-z]+$", 0))
    octet = lambda i: (_byte(stream, F.lit(i)) % 256).cast("string")
    return (
        F.when(kind == "email", F.concat(_like(stream, F.substring(value, F.lit(1), at - 1), never), domain))
        .when(kind == "ip", F.concat_ws(".", F.lit("10"), octet(0), octet(1), octet(2)))
        .when(kind == "phone", _like(stream, value, lambda i, c: i < country))
        .when(kind == "card", _luhn_fixed(_like(stream, value, lambda i, c: i < 1)))
        .when(kind == "iban", _like(stream, value, lambda i, c: i < 2))
        .when(kind == "ssn", _like(stream, value, never))
        .otherwise(_name(stream, value))
    )


def entity_surrogates(entities: DataFrame, params: SurrogateParams) -> DataFrame:
    """(entity, kind, surrogate) for distinct ``entities(entity)``; surrogates are distinct and no entity.

    Of several entities that drew one surrogate the first keeps it and the others
    draw again, as do those whose surrogate is an entity itself.
    """
    rows = entities.withColumn("kind", entity_kind(F.col("entity"))).withColumn("turn", F.lit(0))
    draw = _surrogate(params.secret, F.col("kind"), F.col("entity"), F.col("turn"))
    real = stored(entities.select(F.col("entity").alias("surrogate")), "entities")
    rows = stored(rows.withColumn("surrogate", draw), "surrogates")
    for _ in range(params.rounds + 1):
        # The owner of a surrogate is the smallest (turn, entity) that drew it; nobody owns a real entity.
        owner = rows.groupBy("surrogate").agg(F.min(F.struct("turn", "entity")).alias("owner"), F.count("*").alias("n"))
        taken = owner.where("n > 1").select("surrogate", F.col("owner.entity").alias("owner"))
        taken = taken.unionByName(real.join(owner.select("surrogate"), "surrogate", "left_semi").withColumn("owner", F.lit(None).cast("string")))
        taken = stored(taken.groupBy("surrogate").agg(F.when(F.count_if(F.col("owner").isNull()) == 0, F.max("owner")).alias("owner")), "taken")
        if taken.isEmpty():
            return rows.select("entity", "kind", "surrogate")
        marked = rows.join(taken.withColumn("hit", F.lit(True)), "surrogate", "left")
        redo = F.coalesce(F.col("hit"), F.lit(False)) & ~F.col("owner").eqNullSafe(F.col("entity"))
        rows = stored(
            marked.withColumn("turn", F.when(redo, F.col("turn") + 1).otherwise(F.col("turn")))
            .withColumn("surrogate", F.when(redo, draw).otherwise(F.col("surrogate")))
            .select("entity", "kind", "turn", "surrogate"),
            "surrogates",
        )
    raise ValueError("surrogates still collide; raise SurrogateParams.rounds")


def replace_entities(
    docs: DataFrame, params: SurrogateParams | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text, n_entities, n_distinct), one row per row of ``docs``; ``text`` has surrogates for entities.

    Pieces between mentions stay as they are. A null text stays null with no
    entities; an empty one stays empty. Repeated rows get equal results. Other
    columns are not read.
    """
    params = params or SurrogateParams()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), mentions(F.col(text_col)).alias("found"))
    # Texts without a mention need no lookup; the others meet their entities by a digest of the text.
    some = rows.where(F.size("found") > 0)
    said = stored(some.select(F.md5("text").alias("print"), F.explode(F.array_distinct("found")).alias("entity")).distinct(), "mentions")
    names = entity_surrogates(said.select("entity").distinct(), params)
    # A table of its own, so that the join may split a text that very many rows have.
    lookup = stored(
        said.join(names, "entity").groupBy("print").agg(
            F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("own")
        ),
        "lookup",
    )
    # The lookup grows with the table, so it is no table to broadcast; only texts with a mention are dealt out.
    joined = some.withColumn("print", F.md5("text")).join(lookup.hint("merge"), "print", "left")
    between = F.split("text", ANY, -1)
    new = F.concat(
        F.element_at(between, 1),
        F.array_join(
            F.transform(F.col("found"), lambda e, i: F.concat(F.element_at("own", e), F.get(between, i + 1))), ""
        ),
    )
    told = joined.select(
        F.col("id").alias(id_col),
        new.alias("text"),
        F.size("found").cast("bigint").alias("n_entities"),
        F.size(F.array_distinct("found")).cast("bigint").alias("n_distinct"),
    )
    none = F.lit(0).cast("bigint")
    silent = rows.where(F.coalesce(F.size("found"), F.lit(0)) <= 0)
    return told.unionByName(silent.select(F.col("id").alias(id_col), "text", none.alias("n_entities"), none.alias("n_distinct")))
