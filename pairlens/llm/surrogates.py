"""PII surrogates: keyed replacements that keep type, script, gender and format.

Entities are found by patterns: e-mail addresses, international and grouped phone
numbers, IPv4 addresses, payment card numbers, social security numbers, IBANs,
secrets (after a word such as token, or 32 or more hexadecimal digits) and names
after a title. An entity's norm (lower case; digits only where separators carry no
meaning) and a secret key name a stream of SHA-512 bytes that replaces letters by letters of the
same script, digits by digits, hexadecimal by hexadecimal; a mail domain has a stream of
its own, so one domain stays one domain, and a name is drawn from a list of its
title's gender and its script. Equal norms get equal surrogates wherever and
however they are written. Surrogates that clash, with each other or with an
entity that really occurs, are drawn again until all of a type are distinct. After ``PLAIN`` rounds
names get keyed syllables, mailboxes and secrets keyed characters and phone numbers keyed digits at the end,
one more each round, so that no list or short format runs out; after ``LATE`` rounds the other types do too.
Patterns take time in proportion to the text, whatever it holds: no group without a bound is repeated.

Everything is built from DataFrame functions. Only documents that hold an
entity are joined; others pass by. Null text stays null; texts without entities
and all other columns stay as they are; repeated rows are treated alike.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import fresh_name, materialized

# Detection patterns, by type; the first that matches at a place wins.
PATTERNS = {
    # Bounded as addresses are, and possessive before the @: a long run of letters or dots costs a bounded look at each place.
    "email": r"[\p{L}\p{N}_%+-][\p{L}\p{N}_%+.-]{0,63}+@(?:[\p{L}\p{N}-]{1,63}\.){1,30}\p{L}{2,63}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]{0,127}[0-9])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])"
    r"|(?<=(?i:token|secret|password|passwd|api_key|api-key|apikey) ?[=:] ?[\"']?)(?<![\p{L}\p{N}_-])[\p{L}\p{N}_./+-]{8,}",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?\d[A-Z0-9]{3}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d\p{L}])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,4}(?!\d)"
    r"|(?<![\d+])\(\d{2,4}\) ?\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![\d+.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "name": r"(?<!\p{L})(?:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Г-н|Г-жа)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
ANY = "|".join(PATTERNS.values())
#: What every entity holds; texts without it are not searched further.
HINT = r"[0-9@]|Mrs?\b|Ms\b|Miss\b|Dr\b|Herr\b|Frau\b|M(?:onsieur|adame|me)\b|Señora?\b|Г-н|Г-жа|(?i:token|secret|passw|api.?key)"

FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Г-жа"]
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Г-н"]
GIVEN = {
    ("f", "latin"): "Ada Alma Clara Edith Elsa Flora Greta Hilda Irma Julia Karin Laura Marta Nora Olga Paula Rita Sonia Thea Vera".split(),
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Max Niels Oskar Paul Rolf Simon Theo Viktor".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Зоя Ирина Лидия Мария Нина Ольга Раиса".split(),
    ("m", "cyrillic"): "Антон Борис Вадим Глеб Денис Егор Иван Кирилл Лев Макар Олег Роман".split(),
}
FAMILY_STEMS = {"latin": "Ald Ber Cor Dar El Fal Gan Har Is Jar Kel Lor Mar Nor Ost Per Quin Ros Sel Tor Ul Ver Wal Yar Zan".split(), "cyrillic": "Бел Вол Гор Дуб Жар Зим Кол Лан Мор Нов Ор Пол Руд Сер Тих".split()}
FAMILY_ENDS = {"latin": "ake beck croft den er field gren holm ing lund man ner ow sen ton ura vik wood".split(), "cyrillic": "ан ин ич ко ов ский ух".split()}

ALPHANUMERIC = list("abcdefghijklmnopqrstuvwxyz0123456789")
#: Rounds before surrogates grow, rounds before those of a fixed format do, and what names grow by.
PLAIN = 3
LATE = 10
SYLLABLES = {"latin": "ba de fi go hu ka le mi no pu ra se ti vo wu za".split(), "cyrillic": "ба ве ги до жу за ке ли мо ну па ре си то фу ха".split()}

# Letters of the same script for letters beyond a-z.
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýþÿœß"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"


def _literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _byte(stream: Column, at: Column) -> Column:
    """Byte ``at`` of a hexadecimal SHA-512 stream, read round and round."""
    return F.conv(F.substring(stream, (at % 64 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(words: list[str], value: Column) -> Column:
    return F.element_at(_literal(words), (value % len(words) + 1).cast("int"))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _substituted(text: Column, stream: Column, hexadecimal: Column) -> Column:
    """Each character replaced by one of its class; ``text`` is in lower case."""
    one = lambda c, v: (
        F.when(hexadecimal & c.rlike("^[0-9a-f]$"), _pick(list("0123456789abcdef"), v))
        .when(c.rlike("^[0-9]$"), _pick(list("0123456789"), v))
        .when(c.rlike("^[a-z]$"), _pick(list("abcdefghijklmnopqrstuvwxyz"), v))
        .when(c.rlike(f"^[{ACCENTED}]$"), _pick(list(ACCENTED), v))
        .when(c.rlike(r"^\p{IsCyrillic}$"), _pick(list(CYRILLIC), v))
        .when(c.rlike(r"^\p{IsGreek}$"), _pick(list(GREEK), v))
        .otherwise(c)
    )
    return F.array_join(F.transform(_characters(text), lambda c, i: one(c, _byte(stream, i))), "")


def _tail(words: list[str], stream: Column, start: Column, attempt: Column) -> Column:
    """What is appended in rounds after the first ``PLAIN``: one word more each round, from byte ``start`` of the stream on."""
    extra = attempt - F.lit(PLAIN - 1)
    grown = F.transform(F.sequence(F.lit(1), F.greatest(extra, F.lit(1))), lambda i: _pick(words, _byte(stream, start + i)))
    return F.when(extra > 0, F.array_join(grown, "")).otherwise("")


def type_of(entity: Column) -> Column:
    """The first type whose pattern matches the whole of an entity."""
    out = F.when(F.lit(False), "")
    for kind, pattern in PATTERNS.items():
        bare = r"(?:[0-9A-Fa-f]{32,128}|[\p{L}\p{N}_./+-]{8,})" if kind == "secret" else f"(?:{pattern})"
        if kind != "secret":
            out = out.when(entity.rlike(f"^{bare}$"), kind)
    return out.otherwise("secret")


def norm_of(kind: Column, entity: Column) -> Column:
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return (
        F.when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "iban", F.lower(F.regexp_replace(entity, " ", "")))
        .when(kind == "name", entity)
        .otherwise(F.lower(entity))
    )


def _stream(key: str, salt: Column, what: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", F.lit(key), salt, what, attempt.cast("string")), 512)


def surrogate_norm(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """The surrogate's norm for one attempt."""
    stream = _stream(key, kind, norm, attempt)
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    host, ending = F.regexp_replace(domain, r"\.[^.]+$", ""), F.substring_index(domain, ".", -1)
    no = F.lit(False)
    # A domain's stream does not depend on the attempt: one domain, one surrogate.
    mail = F.concat(_substituted(local, stream, no), _tail(ALPHANUMERIC, stream, F.length(local), attempt), F.lit("@"), _substituted(host, _stream(key, F.lit("domain"), domain, F.lit(0)), no), F.lit("."), ending)
    address = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(stream, i) % 254 + 1).cast("string")), ".")
    digits = _substituted(norm, stream, no)
    valid = lambda d: F.aggregate(
        F.transform(F.reverse(_characters(d)), lambda c, i: F.when(i % 2 == 1, F.lit(2)).otherwise(1) * c.cast("int")),
        F.lit(0),
        lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x),
    ) % 10
    body = F.substring(digits, F.lit(1), F.length(norm) - 1)
    check = ((F.lit(10) - valid(F.concat(body, F.lit("0")))) % 10).cast("string")
    card = F.when(valid(norm) == 0, F.concat(body, check)).otherwise(digits)
    head = F.when(kind == "phone", F.substring(norm, 1, 1)).otherwise("")
    number = F.concat(head, F.substring(digits, F.length(head) + 1, F.length(norm)))
    # A fixed format grows only when its space is all but used up.
    late = _tail(ALPHANUMERIC[26:], stream, F.length(norm), attempt - (LATE - PLAIN))
    phone = F.concat(number, _tail(ALPHANUMERIC[26:], stream, F.length(norm), attempt))
    iban = F.concat(F.substring(norm, 1, 2), F.substring(digits, F.lit(3), F.length(norm)))
    words = F.split(norm, " ")
    hexadecimal = norm.rlike("^[0-9a-f]+$")
    bare = F.regexp_replace(words[0], r"\.$", "")
    script = F.when(F.element_at(words, -1).rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    gender = F.when(bare.isin(FEMALE_TITLES), "f").when(bare.isin(MALE_TITLES), "m").when(_byte(stream, F.lit(9)) % 2 == 0, "f").otherwise("m")
    first = _stream(key, F.concat(F.lit("given"), gender), words[1], attempt)
    given = reduce(
        lambda acc, item: F.when(
            (gender == item[0][0]) & (script == item[0][1]), F.concat(_pick(item[1], _byte(first, F.lit(0))), _tail(SYLLABLES[item[0][1]], first, F.lit(0), attempt))
        ).otherwise(acc),
        GIVEN.items(),
        F.lit(""),
    )
    # The family name has its own stream: who shares it with another goes on sharing it.
    own = _stream(key, F.lit("family"), F.element_at(words, -1), attempt)
    family = F.concat(
        *[F.when(script == "cyrillic", _pick(t["cyrillic"], _byte(own, F.lit(n)) * 256 + _byte(own, F.lit(n + 1)))).otherwise(_pick(t["latin"], _byte(own, F.lit(n)) * 256 + _byte(own, F.lit(n + 1)))) for n, t in ((0, FAMILY_STEMS), (2, FAMILY_ENDS))],
        *[F.when(script == s, _tail(SYLLABLES[s], own, F.lit(3), attempt)).otherwise("") for s in SYLLABLES],
    )
    name = F.when(F.size(words) > 2, F.concat_ws(" ", words[0], given, family)).otherwise(F.concat_ws(" ", words[0], family))
    return (
        F.when(kind == "email", mail)
        .when(kind == "ip", F.concat(address, late))
        .when(kind == "card", F.concat(card, late))
        .when(kind == "phone", phone)
        .when(kind == "ssn", F.concat(number, late))
        .when(kind == "iban", F.concat(iban, late))
        .when(kind == "name", name)
        .otherwise(F.concat(_substituted(norm, stream, hexadecimal), F.when(hexadecimal, _tail(list("0123456789abcdef"), stream, F.length(norm), attempt)).otherwise(_tail(ALPHANUMERIC, stream, F.length(norm), attempt))))
    )


def surrogate_text(kind: Column, entity: Column, surrogate: Column) -> Column:
    """The surrogate's norm written in the entity's format: separators, letter case."""
    step = lambda acc, c: F.when(
        c.rlike("^[0-9A-Za-z]$"), F.struct(F.concat(acc["out"], F.substring(surrogate, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))
    ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at")))
    written = F.aggregate(_characters(entity), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step)
    spaced = F.concat(written["out"], F.substring(surrogate, written["at"], F.length(surrogate)))
    cased = lambda old, new: F.array_join(
        F.transform(
            _characters(new),
            lambda c, i: F.when(F.substring(old, i + 1, F.lit(1)) != F.lower(F.substring(old, i + 1, F.lit(1))), F.upper(c)).otherwise(c),
        ),
        "",
    )
    # The two sides of a mail address apart, as only the first may have grown.
    mail = F.concat_ws("@", *[cased(F.substring_index(entity, "@", k), F.substring_index(surrogate, "@", k)) for k in (1, -1)])
    return (
        F.when(kind.isin("phone", "card", "ssn"), spaced)
        .when(kind == "iban", F.upper(spaced))
        .when(kind.isin("name", "ip"), surrogate)
        .when(kind == "email", mail)
        .otherwise(cased(entity, surrogate))
    )


def choose_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) for distinct (kind, norm): distinct within a kind and none a real entity.

    Every type grows with the rounds, so all are settled in the end.
    """
    open_ = materialized(entities.select("kind", "norm").distinct(), "pii-entities")
    real = open_.select("kind", F.col("norm").alias("surrogate"))
    settled = None
    for attempt in count():
        drawn = open_.withColumn("surrogate", surrogate_norm(key, F.col("kind"), F.col("norm"), F.lit(attempt)))
        drawn = materialized(drawn, "pii-drawn")
        winners = drawn.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm"))
        taken = real if settled is None else real.unionByName(settled.select("kind", "surrogate"))
        new = materialized(winners.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "norm", "surrogate"), "pii-settled")
        settled = new if settled is None else settled.unionByName(new)
        open_ = materialized(open_.join(new, ["kind", "norm"], "left_anti"), "pii-open")
        if open_.isEmpty():
            return settled


def replace_entities(docs: DataFrame, key: str, text: str = "text", n_entities: str = "n_entities") -> DataFrame:
    """``docs`` with every entity in ``text`` replaced, and the number of replacements."""
    docs = docs.select(*[c for c in docs.columns if c != n_entities])
    order = [*docs.columns, n_entities]
    names = [fresh_name(docs, n) for n in ("pii_row", "pii_found", "pii_at", "pii_entity", "pii_all")]
    row, found, at, entity, every = names
    holds = F.coalesce(F.col(text).rlike(HINT) & F.col(text).rlike(ANY), F.lit(False))
    clean = docs.where(~holds).withColumn(n_entities, F.lit(0).cast("long"))
    hit = materialized(
        docs.where(holds)
        .withColumn(row, F.monotonically_increasing_id())
        .withColumn(found, F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))),
        "pii-documents",
    )
    places = hit.select(row, F.posexplode(found).alias(at, entity)).withColumn("kind", type_of(F.col(entity)))
    places = places.withColumn("norm", norm_of(F.col("kind"), F.col(entity)))
    chosen = choose_surrogates(places, key)
    written = (
        places.join(chosen, ["kind", "norm"])
        .select(row, F.struct(F.col(at), surrogate_text(F.col("kind"), F.col(entity), F.col("surrogate")).alias("new")).alias("one"))
        .groupBy(row)
        .agg(F.array_sort(F.collect_list("one")).alias(every))
    )
    pieces = F.split(F.col(text), ANY, -1)
    rebuilt = F.array_join(
        F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col(every), i)["new"], F.lit("")))), ""
    )
    done = (
        hit.join(written, row)
        .withColumn(text, rebuilt)
        .withColumn(n_entities, F.size(found).cast("long"))
        .select(*order)
    )
    return clean.select(*order).unionByName(done)
