"""Surrogates for personal data, with DataFrame operations only.

Mentions (e-mail addresses, phone numbers, card numbers, IPv4 addresses, secrets, titled names) are found by one pattern;
texts that cannot hold one are told apart by byte searches for digits, ``@``, titles and the beginnings of keys, and by a short
pattern for hexadecimal secrets without a digit.
A mention's canonical form names its entity, so that mentions of one entity meet however they are written.  An entity
gets one surrogate everywhere: drawn from a keyed digest, of the same type, and character by character of the same class and
script; a card number that passes its check digit keeps passing, a name keeps the gender of its title.  Surrogates that
collide with each other or with a real entity are drawn again, until all are distinct.  Each mention gets its
entity's surrogate in the mention's own format (separators, case).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medfuse.llm.common import cut, discard, fresh

KEY = "medfuse-surrogates"      # default of the secret key, for tests; production passes its own

# Titles by the gender that they name.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "господин", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "госпожа", "Госпожа")
# Given names and surname syllables by script and gender.
GIVEN = {
    ("latin", "m"): "Adrian Bruno Carl Daniel Emil Felix Gabriel Hugo Ivan Jonas Karl Leo Martin Nils Oskar Paul".split(),
    ("latin", "f"): "Anna Bianca Clara Diana Elena Flora Greta Helena Irene Julia Klara Laura Maria Nina Olga Paula".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Максим Никита Олег Павел Роман Степан".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса Софья".split(),
}
SYLLABLES = {"latin": "ba be bo da de do ka ke ko la le lo ma me mo na".split(), "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на".split()}
ENDING = {("latin", "m"): "rin", ("latin", "f"): "rin", ("cyrillic", "m"): "рин", ("cyrillic", "f"): "рина"}

EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)+"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = (r"(?<![\p{L}0-9+])(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{4}(?![0-9])"
         r"|(?<![\p{L}0-9])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){3,4}(?![0-9])"
         r"|(?<![\p{L}0-9\-])[0-9]{3}[.\-][0-9]{2,3}[.\-][0-9]{4}(?![0-9\-])")
CARD = r"(?<![\p{L}0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){2}[ \-][0-9]{1,7})(?![\p{L}0-9])"
SECRET = (r"(?<![\p{L}0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![\p{L}0-9])")
#: How secrets other than hexadecimal ones begin; those may be letters alone.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")
NAME = r"(?<!\p{L})(?:" + "|".join(MALE + FEMALE) + r")\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){0,2}"
#: In this order; the first that fits at a place wins.
KINDS = (("email", EMAIL), ("ip", IP), ("phone", PHONE), ("secret", SECRET), ("card", CARD), ("name", NAME))
ENTITY = "|".join(f"(?:{p})" for _, p in KINDS)


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def may_hold(text: Column) -> Column:
    """A cheap test that every text with a mention passes."""
    found = [text.contains(s) for s in (*(str(d) for d in range(10)), "@", *MALE, *FEMALE, *PREFIXES)]
    return reduce(lambda a, b: a | b, found) | text.rlike("[a-f]{32}|[A-F]{32}")


def kind_of(mention: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(KINDS[:-1]):
        out = F.when(mention.rlike("^(?:" + pattern + ")$"), F.lit(kind)).otherwise(out)
    return out


def canonical_sql(kind: str, mention: str) -> str:
    """The entity that a mention names: digits alone, lower case, or the name without its title."""
    return f"""CASE {kind}
      WHEN 'email' THEN lower({mention})
      WHEN 'phone' THEN regexp_replace({mention}, '[^0-9+]', '')
      WHEN 'card' THEN regexp_replace({mention}, '[^0-9]', '')
      WHEN 'secret' THEN IF({mention} RLIKE '^[0-9A-F]+$', lower({mention}), {mention})
      WHEN 'name' THEN concat(IF({mention} RLIKE '^(?:{"|".join(MALE)})[. ]', 'm', 'f'), ':', lower(regexp_replace({mention}, '^[^ ]+ ', '')))
      ELSE {mention} END"""


def _stream(seed: str, length: str) -> str:
    """Hex digits of keyed digests, two for each of ``length`` characters."""
    return f"array_join(transform(sequence(0, CAST(({length}) DIV 32 AS INT)), b -> sha2(concat({seed}, '|', b), 256)), '')"


def _number(stream: str, i: str) -> str:
    return f"CAST(conv(substr({stream}, 2 * {i} - 1, 2), 16, 10) AS INT)"


LETTERS = {
    "[0-9]": "0123456789", "[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "[а-яё]": "абвгдежзиклмнопрстуфхцчшэюя", "[А-ЯЁ]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    "[α-ω]": "αβγδεζηθικλμνξοπρστυφχψω", r"\\p{Ll}": "abcdefghijklmnopqrstuvwxyz", r"\\p{L}": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
}


def _shape(text: str, stream: str) -> str:
    """SQL: every letter and digit of ``text`` replaced by one of its class and script; the rest stays."""
    cases = " ".join(f"WHEN substr({text}, i, 1) RLIKE '^{p}$' THEN substr('{a}', {_number(stream, 'i')} % {len(a)} + 1, 1)" for p, a in LETTERS.items())
    return f"IF({text} = '', '', array_join(transform(sequence(1, length({text})), i -> CASE {cases} ELSE substr({text}, i, 1) END), ''))"


def _luhn(digits: str) -> str:
    """SQL: the check sum of a digit string, modulo 10."""
    return (f"aggregate(transform(split(reverse({digits}), ''), (d, i) -> CAST(d AS INT) * (1 + i % 2)), CAST(0 AS BIGINT), (s, x) -> s + x DIV 10 + x % 10) % 10")


def draw(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (kind, entity, attempt) with the column ``surrogate``."""
    seed = f"concat({_q(key)}, '|', kind, '|', entity, '|', attempt)"
    d = entities.selectExpr(
        "kind", "entity", "attempt", f"{_stream(seed, 'length(entity) + 8')} AS stream",
        "IF(kind = 'email', substring_index(entity, '@', 1), '') AS local", "IF(kind = 'email', substring_index(entity, '@', -1), '') AS domain",
        "IF(kind = 'name', split(substr(entity, 3), ' '), array()) AS names", "IF(kind = 'name', substr(entity, 1, 1), '') AS gender",
        "IF(kind = 'name' AND entity RLIKE '[а-яё]', 'cyrillic', 'latin') AS script")
    # after four draws the local part grows: very short ones may have no free value of their own length
    d = d.selectExpr("*", "concat(local, repeat('x', greatest(attempt - 3, 0))) AS longer", "regexp_replace(domain, '[.][^.]*$', '') AS site",
                     f"{_stream(f'concat({_q(key)}, {_q(chr(124) + 'domain' + chr(124))}, domain)', 'length(domain)')} AS site_stream",
                     f"{_stream(f'concat({_q(key)}, {_q(chr(124) + 'given' + chr(124))}, gender, array_join(slice(names, 1, greatest(size(names) - 1, 0)), {_q(' ')}))', '8')} AS given_stream",
                     f"{_stream(f'concat({_q(key)}, {_q(chr(124) + 'family' + chr(124))}, coalesce(try_element_at(names, -1), {_q('')}), IF(attempt = 0, {_q('')}, concat({_q(chr(124))}, entity, attempt)))', '8')} AS family_stream")
    given = " ".join(f"WHEN script = '{s}' AND gender = '{g}' THEN array({', '.join(_q(n) for n in names)})" for (s, g), names in GIVEN.items())
    parts = " ".join(f"WHEN '{s}' THEN array({', '.join(_q(n) for n in names)})" for s, names in SYLLABLES.items())
    ends = " ".join(f"WHEN script = '{s}' AND gender = '{g}' THEN '{e}'" for (s, g), e in ENDING.items())
    family = (f"initcap(concat(array_join(transform(sequence(1, 6), i -> (CASE script {parts} END)[{_number('family_stream', 'i')} % 16]), ''), CASE {ends} END))")
    firsts = f"array_join(transform(slice(names, 1, greatest(size(names) - 1, 0)), (n, i) -> (CASE {given} END)[{_number('given_stream', '(i + 1)')} % 16]), ' ')"
    tail = _shape("substr(entity, 2)", "stream")
    return d.selectExpr(
        "kind", "entity", "attempt", f"""CASE kind
          WHEN 'email' THEN concat({_shape('longer', 'stream')}, '@', {_shape('site', 'site_stream')}, substr(domain, length(site) + 1))
          WHEN 'ip' THEN array_join(transform(sequence(1, 4), i -> CAST(1 + {_number('stream', 'i')} % 254 AS STRING)), '.')
          WHEN 'phone' THEN IF(startswith(entity, '+'), concat(substr(entity, 1, 2), {_shape('substr(entity, 3)', 'stream')}), {_shape('entity', 'stream')})
          WHEN 'card' THEN concat(substr(entity, 1, 1), {tail})
          WHEN 'secret' THEN IF(entity RLIKE '^[0-9a-f]+$', array_join(transform(sequence(1, length(entity)), i -> substr('0123456789abcdef', {_number('stream', 'i')} % 16 + 1, 1)), ''),
                                concat(substr(entity, 1, 4), {_shape('substr(entity, 5)', 'stream')}))
          ELSE concat(gender, ':', lower(trim(concat({firsts}, ' ', {family})))) END AS surrogate""").selectExpr(
        "kind", "entity", "attempt", f"""IF(kind = 'card' AND {_luhn("IF(kind = 'card', entity, '0')")} = 0,
          concat(substr(surrogate, 1, length(surrogate) - 1),
                 CAST((10 - {_luhn("concat(IF(kind = 'card', substr(surrogate, 1, length(surrogate) - 1), ''), '0')")}) % 10 AS STRING)), surrogate) AS surrogate""")


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate): all surrogates distinct, and none of them an entity of the corpus."""
    drawn = cut(draw(entities.select("kind", "entity", F.lit(0).alias("attempt")), key))
    while True:
        twice = drawn.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("first")).where("n > 1")
        taken = drawn.select("kind", F.col("entity").alias("surrogate"))
        rivals = drawn.join(twice.select("kind", "surrogate", "first"), ["kind", "surrogate"]).where("entity <> first").select("kind", "entity")
        real = drawn.join(taken, ["kind", "surrogate"], "left_semi").select("kind", "entity")
        again = cut(rivals.unionByName(real).distinct())
        if not again.limit(1).count():
            discard(again)
            return drawn.select("kind", "entity", "surrogate")
        marked = drawn.join(again.withColumn("redo", F.lit(1)), ["kind", "entity"], "left")
        redone = draw(marked.where("redo = 1").select("kind", "entity", (F.col("attempt") + 1).alias("attempt")), key)
        after = cut(marked.where("redo IS NULL").select("kind", "entity", "attempt", "surrogate").unionByName(redone))
        discard(drawn)
        discard(again)
        drawn = after


def dressed_sql() -> str:
    """SQL: the surrogate in the format of the mention."""
    digits = ("array_join(zip_with(split(regexp_replace(mention, '[0-9]', '#'), '#'), split(regexp_replace(surrogate, '[^0-9]', ''), ''), "
              "(a, b) -> concat(coalesce(a, ''), coalesce(b, ''))), '')")
    cased = ("array_join(transform(sequence(1, length(surrogate)), i -> IF(substr(mention, i, 1) RLIKE '^\\\\p{Lu}$', upper(substr(surrogate, i, 1)), "
             "substr(surrogate, i, 1))), '')")
    return f"""CASE kind WHEN 'phone' THEN {digits} WHEN 'card' THEN {digits} WHEN 'email' THEN {cased}
      WHEN 'secret' THEN IF(mention RLIKE '^[0-9A-F]+$', upper(surrogate), surrogate)
      WHEN 'name' THEN concat(regexp_extract(mention, '^[^ ]+ ', 0), initcap(substr(surrogate, 3))) ELSE surrogate END"""


def mentions_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, place, mention, kind, entity) of every mention; repeated rows share their mentions."""
    text = F.col(f"`{text_col}`")
    some = docs.select(F.xxhash64(F.col(f"`{id_col}`"), text).alias("rid"), F.when(may_hold(text), text).alias("text"))
    found = some.select("rid", F.posexplode_outer(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).alias("place", "mention")).where("mention IS NOT NULL")
    kinds = found.groupBy("rid", "place", "mention").agg(F.lit(1).alias("one")).select("rid", "place", "mention", kind_of(F.col("mention")).alias("kind"))
    return kinds.selectExpr("rid", "place", "mention", "kind", f"{canonical_sql('kind', 'mention')} AS entity")


def replace_mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with every mention replaced in its text, and the number of mentions as column ``n_mentions``.

    A NULL text stays NULL, an empty one empty; both have no mentions.  Equal rows get equal results and all stay; a NULL id is
    an id like any other.  An entity has one surrogate in the whole table; the same key gives the same surrogates for the same set
    of entities.  Other columns pass through (``n_mentions`` gets underscores where taken); an empty table gives an empty result.
    """
    mentions = cut(mentions_of(docs, id_col, text_col))
    surrogates = cut(distinct_surrogates(mentions.select("kind", "entity").distinct(), key))
    rid, other, new, n_mentions = fresh(docs, "rid", "rid_of_mentions", "replacements", "n_mentions")
    per_row = (mentions.join(surrogates, ["kind", "entity"]).selectExpr("rid", "place", f"{dressed_sql()} AS dressed")
               .groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("place", "dressed"))).alias("found"))
               .select(F.col("rid").alias(other), F.transform("found", lambda x: x["dressed"]).alias(new)))
    text = F.col(f"`{text_col}`")
    rows = docs.withColumn(rid, F.xxhash64(F.col(f"`{id_col}`"), text))
    both = rows.join(per_row.hint("merge"), rows[rid] == per_row[other], "left")
    rebuilt = F.array_join(F.zip_with(F.split(text, ENTITY), F.col(new), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return both.select(*[(F.when(F.col(new).isNull(), text).otherwise(rebuilt).alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns],
                       F.coalesce(F.size(F.col(new)), F.lit(0)).cast("bigint").alias(n_mentions))
