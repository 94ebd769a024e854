"""Surrogates for personal data: keyed, of the same type and format, distinct and coreferent.

Native: DataFrame functions only.  One pattern finds e-mail addresses, phone, card, account and social
security numbers, IP addresses, secrets and titled names; a detected name is also found where it stands
without title in the same text.  A mention is reduced to its canonical form (digits only, lower case, ...).
Its surrogate is a keyed permutation of the forms of its format: the characters that may change are numbers
in their alphabets (digits, letters of a case and script, octets; in names vowels and consonants apart),
and in each of ``ROUNDS`` rounds every second one moves by a keyed SHA-512 of the others.  So different forms have
different surrogates by construction, and equal forms equal ones everywhere, however they are written and
whatever stands before them.  Separators and case stay, as do the last label of an address, the country of
a phone or account number, the prefix of a key and the last letter of a name, which carries its gender; a
card's last digit keeps its distance from the check digit, so valid numbers stay valid.

Over the whole corpus it is checked that no surrogate is some real form, and that none is made twice (letters of
scripts without an alphabet here become Latin ones, which is no permutation).  Such exceptions take
the first of ``ATTEMPTS`` further permutations (of a name, with syllables added) that is neither real nor made for any other.
Where a format is so crowded that none is, the first surrogate stays, which is distinct, though a real form that is itself replaced;
a form that would be its own surrogate then takes turns with another of its format.  Exceptions are few and
reach the documents by a join; all other surrogates need none.

Defined results: a null text stays null, with 0 entities; text outside mentions does not change; overlapping mentions go
to the leftmost; rows that repeat an id are each treated; equal IPv6 addresses written differently count as different.  Texts may
be of any length; work on a mention grows with its length.  An empty table gives no rows.  Other columns do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from csvloom.llm.common import partitions, stage

#: Titles before a name (fixed values).
TITLES = [
    "Mr", "Mister", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Sr", "Don", "Signor", "Господин", "Κύριος",
    "Mrs", "Ms", "Miss", "Mx", "Madam", "Lady", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "Signora", "Госпожа", "Κυρία",
    "Dr", "Prof", "Rev", "Capt",
]
#: Alphabets in which the letters of a name are replaced (fixed values).
NAME_ALPHABETS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "áàâäãåéèêëíìîïóòôöõúùûü", "ñçšžčćłńśźż", "аеёиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ"]
#: Alphabets of the letters of addresses and accounts (fixed values).
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "áàâäãåéèêëíìîïóòôöõúùûüñçšžčćłńśźż", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
DIGITS, HEX_LETTERS, HEX = "0123456789", "abcdef", "0123456789abcdef"
#: Syllables that make room for names are of these (fixed values).
CONSONANTS, VOWELS = {"Latin": "bdfgklmnprstvz", "Cyrillic": "бвгдзклмнпрст", "Greek": "βγδζθκλμνπρστ"}, {"Latin": "aeiou", "Cyrillic": "аеиоу", "Greek": "αεηιου"}

_ANY_TITLE = "|".join(TITLES)
_NAME = r"\p{Lu}\p{L}*+(?:['’](?!s(?!\p{L}))\p{L}++|-\p{L}++)*+"
_PART = r"\p{Lu}[\p{L}'’-]{0,30}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_GROUP = r"[0-9A-Fa-f]{1,4}"
#: What keys of services begin with, and which characters follow.
_PREFIXED = r"(?:sk|pk|rk)[-_][0-9A-Za-z_-]{16,}+|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{30,}+|xox[abprs]-[0-9A-Za-z-]{10,}+|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+"
#: The kinds of mention, in order of preference where several could begin at one place.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "key": rf"(?<![0-9A-Za-z])(?=[skprAgxe])(?=(?:[spr]k[-_]|A[KSI]|gh|xo|ey))(?=[0-9A-Za-z_.-]*[0-9])(?:{_PREFIXED})(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?=[A-Za-z]*[0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?=[0-9A-Z]{0,24}\d{6})[0-9A-Z]{11,30}(?![0-9A-Za-z])",
    "ip6": rf"(?<![\w:.])(?=[0-9A-Fa-f]{{0,4}}:)(?=[0-9A-Fa-f:]*\d)(?:{_GROUP}(?::{_GROUP}){{7}}|(?=(?:[0-9A-Fa-f]*:){{3}})(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:{_GROUP}(?::{_GROUP}){{0,6}})?)(?![\w:])",
    "card": r"(?<![\d.])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?![\d])",
    "phone": r"(?<![\w.])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w.])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\w)",
    # a value that is named as a secret; its name stays
    "password": r"(?<=[\"' :=])(?=[0-9A-Za-z+/_-]{12})(?<=(?:password|passwd|secret|token|api_key|apikey|api-key)[\"']? ?[:=] ?[\"']?)(?=[0-9A-Za-z+/_-]*[0-9])[0-9A-Za-z+/_-]{12,}+(?![0-9A-Za-z])",
    # up to three parts after a title, each a mention of its own
    "name": rf"(?=\p{{Lu}})(?<= )(?<=(?<!\p{{L}})(?:{_ANY_TITLE})\.? (?:|{_PART} |{_PART} {_PART} )){_NAME}",
}
#: A cheap test that most places fail and no mention does: after an ASCII letter or digit only numbers begin (a card,
#: whatever stands before it), after another letter or digit also secrets and accounts.  Each kind has its own left border.
_BEGIN = r"(?:(?<![\p{L}\p{N}])|(?=[0-9+(])|(?<=[^\x00-\x7F])(?=[A-Za-z]))"
PATTERN = rf"{_BEGIN}(?:{'|'.join(KINDS.values())})"
#: What a text with any mention has somewhere.
_SOME = rf"@|\d{{4}}|\d{{3}}[-)]|\+\d|\d\.\d|[0-9A-Fa-f]{{16}}|[0-9A-Fa-f]:[0-9A-Fa-f]{{0,4}}:|::[0-9A-Fa-f]|[spr]k[-_]|A[KSI]|gh[pousr]_|xox|eyJ|passw|secret|token|api|(?<!\p{{L}})(?:{_ANY_TITLE})\.? \p{{Lu}}"
#: Titles that no other title begins with.
_STEMS = [t for t in TITLES if not any(t != other and t.startswith(other) for other in TITLES)]
#: Stands at both ends of a mention while a text is taken apart.
_MARK = "\x01"
#: Rounds of a permutation, and permutations that exceptions try.
ROUNDS, ATTEMPTS = 8, 8
#: Kinds of which only the digits count, and those where case makes a difference.
NUMBERS, CASED = ("card", "phone", "ssn"), ("key", "password")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _kind(m: Column) -> Column:
    out = F.when(F.contains(m, F.lit("@")), F.lit("email")).when(m.rlike(rf"^{_NAME}$"), F.lit("name"))
    for name in ("key", "secret", "iban", "ip6", "card", "ssn", "ip"):
        out = out.when(m.rlike(f"^(?:{KINDS[name]})$"), F.lit(name))
    return out.when(m.rlike(r"^[0-9A-Za-z+/_-]*[A-Za-z][0-9A-Za-z+/_-]*$") | m.rlike(r"^\d{12}$"), F.lit("password")).otherwise(F.lit("phone"))


def _form(m: Column, kind: Column) -> Column:
    octets = F.array_join(F.transform(F.split(m, r"\."), lambda o: o.cast("int").cast("string")), ".")
    return F.when(kind.isin(*NUMBERS), F.regexp_replace(m, r"[^\d+]", "")).when(kind == "ip", octets).when(kind.isin(*CASED), m).otherwise(F.lower(m))


def _with_parts(docs: DataFrame) -> DataFrame:
    """Adds ``parts``: the text in order, as structs (m, kind, form) with null kind for what is no mention."""
    # most texts have nothing that any kind needs; one that holds the mark itself is matched twice instead
    found = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    apart = F.split("text", PATTERN, -1)
    alternating = F.flatten(F.transform(apart, lambda b, i: F.when(i < F.size(apart) - 1, F.array(b, F.get(found, i))).otherwise(F.array(b))))
    marked = F.split(F.regexp_replace("text", PATTERN, f"{_MARK}$0{_MARK}"), _MARK, -1)
    cheap = reduce(lambda a, b: a | b, (F.contains("text", F.lit(t)) for t in _STEMS), F.col("text").rlike("[0-9@]"))
    pieces = F.when(~(cheap & F.col("text").rlike(_SOME)), F.array("text")).when(F.contains("text", F.lit(_MARK)), alternating).otherwise(marked)
    cut = docs.withColumn("pieces", pieces)
    plain = lambda t: F.struct(t.alias("m"), F.lit(None).cast("string").alias("kind"))
    mention = lambda m, kind: F.struct(m.alias("m"), kind.alias("kind"))
    cut = cut.withColumn("parts", F.transform("pieces", lambda t, i: F.when(i % 2 == 0, plain(t)).otherwise(mention(t, _kind(t)))))
    # names that a title told of, where they stand alone
    names = F.transform(F.filter("parts", lambda x: x["kind"] == "name"), lambda x: x["m"])
    cut = cut.withColumn("names", F.array_distinct(F.concat(names, F.transform(names, F.upper))))
    words = lambda t: F.regexp_extract_all(t, F.lit(rf"{_NAME}|[\p{{L}}\p{{N}}]++|[^\p{{L}}\p{{N}}]++"), F.lit(0))
    alone = F.flatten(
        F.transform(
            "parts",
            lambda x: F.when(
                x["kind"].isNull(), F.transform(words(x["m"]), lambda w: mention(w, F.when(F.array_contains("names", w), F.lit("name"))))
            ).otherwise(F.array(x)),
        )
    )
    cut = cut.withColumn("parts", F.when(F.size("names") > 0, alone).otherwise(F.col("parts")))
    form = F.transform("parts", lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), F.when(x["kind"].isNotNull(), _form(x["m"], x["kind"])).alias("form")))
    return cut.withColumn("parts", form).drop("pieces", "names")


def _characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _alphabet(c: Column, i: Column, n: Column, form: Column, kind: Column) -> Column:
    """The alphabet in which a character of a form is replaced; empty if it stays, null if it is a letter of none."""

    def among(alphabets: list[str]) -> Column:
        out = F.when(c.rlike(r"^\d$"), F.lit(DIGITS))
        for a in alphabets:
            out = out.when(F.contains(F.lit(a), c), F.lit(a))
        return out.when(~c.rlike(r"^\p{L}$"), F.lit(""))

    stays = F.when(kind == "name", (i == n - 1) & (n > 1)).when(kind == "iban", i < 2).when(kind == "card", i == n - 1).when(kind == "phone", F.startswith(form, F.lit("+")) & (i < 2))
    stays = stays.when(kind == "email", i >= n - F.length(F.regexp_extract(form, r"(\.[^.@]*)$", 1))).when(kind == "key", i < F.length(F.regexp_extract(form, r"^(AKIA|ASIA|AIza|eyJ|[a-z]+[-_])", 1)))
    of = F.when(kind == "name", among(NAME_ALPHABETS)).when(kind.isin(*CASED), among([ALPHABETS[0], ALPHABETS[0].upper()]))
    of = of.when(kind == "secret", among([HEX_LETTERS])).when(kind == "ip6", F.when(F.contains(F.lit(HEX), c), F.lit(HEX)).otherwise(F.lit(""))).otherwise(among(ALPHABETS))
    return F.when(F.coalesce(stays, F.lit(False)), F.lit("")).otherwise(of)


def _permuted(values: Column, bases: Column, tweak: Column, key: str) -> Column:
    """A keyed permutation of lists of numbers below ``bases``: every second number moves by a hash of the others, in turn."""
    secret = F.sha2(F.lit(key), 256)

    def turn(held: Column, r: Column) -> Column:
        rest = F.array_join(F.transform(F.filter(held, lambda _, i: i % 2 != r % 2), lambda v: v.cast("string")), ",")
        stream = F.sha2(F.concat_ws("\x1f", secret, tweak, r.cast("string"), rest), 512)
        move = lambda s, i: F.conv(F.substring(s, (i * F.lit(7)) % F.lit(121) + F.lit(1), F.lit(7)), 16, 10).cast("int")
        return _let(stream, lambda s: F.transform(held, lambda v, i: F.when(i % 2 == r % 2, (v + move(s, i)) % F.get(bases, i)).otherwise(v)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, turn)


def _luhn(digits: Column) -> Column:
    """The check digit that belongs after some digits."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return (F.lit(10) - total % 10) % 10


def _made(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical form, in canonical form."""
    n = F.length(form)
    tweak = F.concat_ws("\x1f", kind, attempt.cast("string"))

    def spelled(chars: Column) -> Column:
        stay = F.filter(chars, lambda x: x["a"] == "")
        move = F.filter(chars, lambda x: x["a"] != "")
        # what stays goes into the hash; not a card's last digit, of which only the distance from the check digit stays
        fixed = F.when(kind == "card", F.lit("")).otherwise(F.array_join(F.transform(stay, lambda x: x["c"]), ""))
        known = F.concat_ws("\x1f", tweak, fixed, F.array_join(F.filter(F.transform(move, lambda x: F.when(x["o"], x["c"]).otherwise(F.lit(""))), lambda c: c != ""), ""))
        values = F.transform(move, lambda x: F.when(x["o"], F.ascii(x["c"]) % 26).otherwise(F.call_function("instr", x["a"], x["c"]) - 1))
        new = _permuted(values, F.transform(move, lambda x: F.length(x["a"])), known, key)
        put = F.zip_with(move, new, lambda x, v: F.struct(x["p"].alias("p"), F.substring(x["a"], v + 1, F.lit(1)).alias("c")))
        all_ = F.array_sort(F.concat(F.transform(stay, lambda x: F.struct(x["p"].alias("p"), x["c"].alias("c"))), put))
        return F.array_join(F.transform(all_, lambda x: x["c"]), "")

    # o: a letter of no alphabet here, which becomes a Latin one and goes into the hash
    chars = F.transform(
        _characters(form),
        lambda c, i: _let(_alphabet(c, i, n, form, kind), lambda a: F.struct(i.alias("p"), c.alias("c"), F.coalesce(a, F.lit(ALPHABETS[0])).alias("a"), a.isNull().alias("o"))),
    )
    made = _let(chars, spelled)
    prefix = lambda s: F.substring(s, F.lit(1), n - 1)
    card = _let(made, lambda x: F.concat(prefix(x), F.pmod(_luhn(prefix(x)) + F.substring(form, n, F.lit(1)).cast("int") - _luhn(prefix(form)), F.lit(10)).cast("string")))
    octets = F.array_join(F.transform(_permuted(F.transform(F.split(form, r"\."), lambda o: o.cast("int")), F.array_repeat(F.lit(256), 4), tweak, key), lambda v: v.cast("string")), ".")
    script = lambda of: F.when(form.rlike(r"\p{IsCyrillic}"), F.lit(of["Cyrillic"])).when(form.rlike(r"\p{IsGreek}"), F.lit(of["Greek"])).otherwise(F.lit(of["Latin"]))
    # of names, attempts add syllables before the last letter
    stream = F.sha2(F.concat_ws("\x1f", F.sha2(F.lit(key), 256), tweak, form), 512)
    pick = lambda s, i, of: F.substring(of, (F.conv(F.substring(s, i * F.lit(4) + F.lit(1), F.lit(4)), 16, 10).cast("int") % F.length(of) + 1).cast("int"), F.lit(1))
    more = _let(stream, lambda s: F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda i: F.concat(pick(s, i * 2, script(CONSONANTS)), pick(s, i * 2 + 1, script(VOWELS)))), ""))
    longer = _let(made, lambda x: F.concat(prefix(x), more, F.substring(x, n, F.lit(1))))
    return F.when(kind == "ip", octets).when(kind == "card", card).when((kind == "name") & (attempt > 0), longer).otherwise(made)


def _laid(m: Column, kind: Column, made: Column) -> Column:
    """A surrogate as the mention is written: its separators, its case."""

    def digits(chars: Column) -> Column:
        place = lambda x: x.rlike(r"^\d$")
        at = F.filter(F.transform(chars, lambda c, i: F.struct(i.alias("p"), c.alias("c"))), lambda x: place(x["c"]))
        rest = F.filter(F.transform(chars, lambda c, i: F.struct(i.alias("p"), c.alias("c"))), lambda x: ~place(x["c"]))
        new = F.zip_with(at, _characters(F.regexp_replace(made, r"\D", "")), lambda x, d: F.struct(x["p"].alias("p"), d.alias("c")))
        return F.array_join(F.transform(F.array_sort(F.concat(rest, new)), lambda x: x["c"]), "")

    def cased(chars: Column) -> Column:
        upper = lambda i: F.coalesce(F.get(chars, i).rlike(r"^\p{Lu}$"), F.lit(False))
        return F.array_join(F.transform(_characters(made), lambda c, i: F.when(upper(i), F.upper(c)).otherwise(c)), "")

    whole = (F.upper(m) == m) & (F.length(m) > 1) & ~kind.isin(*CASED, "ip")
    return (
        F.when(kind.isin(*NUMBERS), _let(_characters(m), digits)).when(kind.isin(*CASED, "ip") | (F.lower(m) == m), made).when(whole, F.upper(made)).otherwise(_let(_characters(m), cased))
    )


def exceptions(forms: DataFrame, key: str) -> DataFrame:
    """Forms (kind, form, made) whose surrogate is not the first permutation's.

    ``forms``: distinct (kind, form).
    """
    forms = forms.repartition(partitions(forms.sparkSession), "kind", "form")  # little to read, much to compute
    held = stage(forms.withColumn("made", _made(F.col("kind"), F.col("form"), F.lit(0), key)), "pii-forms")
    taken = held.select("kind", F.col("form").alias("made")).unionByName(held.select("kind", "made"))
    first = held.groupBy("kind", "made").agg(F.min("form").alias("form")).select("kind", "form")
    real = held.join(held.select("kind", F.col("form").alias("made")), ["kind", "made"], "left_semi").select("kind", "form", "made")
    twice = held.join(first, ["kind", "form"], "left_anti").select("kind", "form", "made")
    left = stage(real.unionByName(twice).distinct(), "pii-left")
    out: list[DataFrame] = []
    for attempt in range(1, ATTEMPTS + 1):
        if left.isEmpty():
            break
        tried = stage(left.withColumn("new", _made(F.col("kind"), F.col("form"), F.lit(attempt), key)), "pii-tried")
        free = tried.select("kind", F.col("new").alias("made"), "form").join(taken, ["kind", "made"], "left_anti")
        got = stage(free.groupBy("kind", "made").agg(F.min("form").alias("form")).select("kind", "form", "made"), "pii-got")
        out.append(got)
        taken = taken.unionByName(got.select("kind", "made"))
        left = stage(left.join(got, ["kind", "form"], "left_anti"), "pii-left")
    if not left.isEmpty():
        # crowded formats: the first surrogate stays, unless it is the form itself, which changes places with others of its format
        shape = F.regexp_replace(F.regexp_replace("form", r"\d", "0"), r"[a-z]", "a")
        own = left.where("made = form").select("kind", "form", "made").withColumn("shape", shape)
        rest = left.where("made <> form").select("kind", "form", "made").withColumn("shape", shape)
        partner = rest.join(own.select("kind", "shape").distinct(), ["kind", "shape"], "left_semi").groupBy("kind", "shape").agg(F.min(F.struct("form", "made")).alias("x"))
        ring = own.unionByName(partner.select("kind", "x.form", "x.made", "shape"))
        after = Window.partitionBy("kind", "shape").orderBy("form")
        turn = ring.withColumn("made", F.coalesce(F.lead("made").over(after), F.first("made").over(after))).select("kind", "form", "made")
        out.append(stage(turn, "pii-turn"))
    made = left.limit(0).select("kind", "form", "made")
    for some in out:
        made = made.unionByName(some)
    return made


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``text`` with surrogates and ``n_entities`` (each part of a name counts)."""
    narrow = _with_parts(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")))
    found = F.filter("parts", lambda x: x["kind"].isNotNull())
    each = narrow.select("id", "th", F.explode(found).alias("e")).select("id", "th", "e.kind", "e.form")
    mentions = stage(each.distinct(), "pii-mentions")
    special = stage(exceptions(mentions.select("kind", "form").distinct(), key), "pii-exceptions")
    name = F.concat_ws(":", "kind", "form")
    if special.isEmpty():
        rows = narrow.withColumn("other", F.lit(None).cast("map<string,string>"))
    else:
        mine = mentions.join(special, ["kind", "form"]).groupBy("id", "th").agg(F.map_from_entries(F.collect_list(F.struct(name, "made"))).alias("other"))
        mine = stage(mine.withColumnsRenamed({"id": "__id", "th": "__th"}), "pii-other")  # its size on disk decides on a broadcast
        rows = narrow.join(mine, F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left").drop("__id", "__th")

    made = lambda x: F.coalesce(F.try_element_at("other", F.concat_ws(":", x["kind"], x["form"])), _made(x["kind"], x["form"], F.lit(0), key))
    new = rows.withColumns(
        {
            "n": F.size(found).cast("long"),
            "new": F.transform("parts", lambda x: F.when(x["kind"].isNull(), x["m"]).otherwise(_let(made(x), lambda y: _laid(x["m"], x["kind"], y)))),
        }
    )
    return new.select(
        F.col("id").alias(id_col), F.when(F.col("n") > 0, F.array_join("new", "")).otherwise(F.col("text")).alias("text"), F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).cast("long").alias("n_entities")
    )
