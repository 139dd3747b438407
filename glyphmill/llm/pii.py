"""Surrogates for personal data. DataFrame functions only.

Detected are e-mail addresses, secrets (access keys, whatever follows a keyword such as "password:" up to white space or a
quote, long hexadecimal strings), account numbers (IBAN), IPv4 and IPv6 addresses, telephone numbers (international, or as
written in the United States), social security numbers, card numbers and names after a title. Each entity has a *canonical* form (case and layout dropped), and the
surrogate is a function of a key, the type and the canonical form: all mentions of an entity get the same one, in
any document and layout (coreference). The surrogate keeps type and format: letters stay letters, digits digits,
hexadecimal stays hexadecimal, layout and case are those of the mention; country codes and a card's first digit stay,
a card number that passes the Luhn test gets one that passes, an account number gets its check digits; addresses lie in domains reserved for examples; a given
name is replaced by one of the same gender (told by the title) and script, a surname by one in the same script.
Where a space is too small for a corpus, later attempts widen it: made-up names get more syllables and stand in for given
names when the list is used up, and e-mail addresses and secrets get more letters.

Distinctness is checked on the whole corpus: the distinct entities form a table; entities whose surrogates coincide, or
coincide with another real entity, are drawn anew, all but the least of them, until none is left. The usual case, no
collision, needs no join with the texts. Otherwise the exceptional surrogates go to the documents that mention them
by a join on the document id, which Spark broadcasts only if they are small.

Null text stays null and has no entities. Repeated rows and null ids are fine: replacement is row-wise. An empty table
gives an empty table; columns of any name are carried along. Mentions have no greatest length, and no pattern goes back
over a run it has read, so a text of a megabyte takes linear time whatever it holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import free_name, let, materialise

#: Default key; give your own, and keep it secret.
KEY = "glyphmill-surrogates"
MOST_ATTEMPTS = 50
#: Attempts within the format (e-mail addresses, secrets) or the list (given names); later ones leave it.
STRICT_ATTEMPTS = 3
#: Syllables that later attempts add to a name, at most: 20**12 names.
MORE_SYLLABLES = 9

#: Titles and given names by gender; names by script.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"),
    "n": ("Dr", "Prof"),
}
GIVEN = {
    ("f", "latin"): ("Anna", "Clara", "Elena", "Emma", "Julia", "Laura", "Lucia", "Maria", "Nora", "Sara", "Sofia", "Vera"),
    ("m", "latin"): ("Adam", "Bruno", "David", "Felix", "Hugo", "Jonas", "Leo", "Martin", "Oscar", "Paul", "Robert", "Simon"),
    ("f", "cyrillic"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Сергей"),
}
SYLLABLES = {
    "latin": ("ba", "bel", "dan", "do", "fen", "gar", "hol", "ken", "la", "lin", "mar", "mo", "nel", "pe", "ra", "ros", "sen", "tal", "ver", "win"),
    "cyrillic": ("ба", "бел", "вин", "гор", "дан", "до", "зар", "кен", "ла", "лин", "мар", "мо", "нел", "пе", "ра", "рос", "сен", "тал"),
}

_GAP = r"[ .\-#*$%&|<>!]{0,6}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX4 = "[0-9A-Fa-f]{1,4}"
_TITLE = "|".join(t for group in TITLES.values() for t in group)
_KEYWORD = r"(?i:password|passwd|pwd|secret|token|api[_\-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
#: A name's word: Smith, McDonald, O'Brien, Smith-Jones.
_WORD = r"\p{Lu}['’]?\p{Lu}?\p{Ll}++(?:['’\-]?\p{Lu}\p{Ll}++)*+"
#: Types in the order in which they are tried at a place. Repeats are possessive or bounded: no way back, no recursion.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "secret": rf"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{{16}}(?![A-Za-z0-9])|{_KEYWORD}[^\s\"']{{6,}}+|(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{{32,}}+(?![A-Za-z0-9]))",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ip6": rf"(?<![\w:.])(?:(?:{_HEX4}:){{7}}{_HEX4}|(?:{_HEX4}:){{1,6}}(?::{_HEX4}){{1,6}})(?![\w:])",
    "phone": rf"\+\d{{1,3}}{_GAP}\(?\d{{2,4}}\)?{_GAP}\d{{3,4}}{_GAP}\d{{3,4}}(?!\d)|(?<![\w.+\-])(?:\(\d{{3}}\)[ ]?|\d{{3}}[\-.])\d{{3}}[\-.]\d{{4}}(?![\w\-]|\.\d)",
    "ssn": r"(?<![\w\-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w\-])",
    "card": r"(?<![\d.+])(?:\d{4}(?:[ \-]?\d{4}){3}|3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5})(?!\d)",
    "name": rf"(?<![\p{{L}}\d])(?:{_TITLE})\.?[ ]{_WORD}(?:[ ]{_WORD})?(?!\p{{L}})",
}
#: Where a mention can start: at a digit, "+" or "(", or at another first character with no letter or digit before it. All
#: patterns imply it; it spares the other places, most of a text, the attempt of every pattern.
_INITIALS = "".join(sorted({t[0] for group in TITLES.values() for t in group}))
_START = rf"(?=[0-9+(]|(?<![A-Za-z0-9])[A-Za-z{_INITIALS}._%\-])"
UNION = f"{_START}(?:{'|'.join(f'(?:{p})' for p in PATTERNS.values())})"
#: A text without any of these has no entity.
GATE = rf"(?=[0-9@=:A{_INITIALS}])(?:[0-9@=:]|AKIA|(?:{_TITLE})\.?[ ]\p{{Lu}})"


def type_of(mention: Column) -> Column:
    out = None
    for kind, p in PATTERNS.items():
        test = F.regexp_like(mention, F.lit(rf"^(?:{p})$"))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def _value(mention: Column, kind: Column) -> Column:
    """The part of a mention that is replaced: without keyword or title, and without the punctuation after a secret."""
    bare = F.regexp_replace(mention, f"^{_KEYWORD}", "")
    ended = F.regexp_replace(bare, r"(?<![.,;:!?)\]}>])[.,;:!?)\]}>]++$", "")
    return F.when(kind == "secret", F.when(ended == "", bare).otherwise(ended)).when(kind == "name", F.regexp_replace(mention, rf"^(?:{_TITLE})\.?[ ]", "")).otherwise(mention)


def _gender(mention: Column) -> Column:
    starts = lambda g: F.regexp_like(mention, F.lit(rf"^(?:{'|'.join(TITLES[g])})\.?[ ]"))
    given = F.lower(F.regexp_extract(mention, rf"^(?:{_TITLE})\.?[ ](\p{{L}}+)", 1))
    known = lambda g: given.isin(*(n.lower() for (k, _), names in GIVEN.items() if k == g for n in names))
    return F.when(starts("f") | (~starts("m") & known("f")), "f").otherwise("m")


def canonical(mention: Column, kind: Column) -> Column:
    """Canonical form; a name's tells its gender too, so that it alone decides on the surrogate."""
    v = _value(mention, kind)
    digits = F.regexp_replace(mention, "[^0-9]", "")
    code = F.length(F.regexp_extract(mention, "^\\+([0-9]{1,3})", 1)).cast("string")
    return (
        F.when((kind == "phone") & mention.startswith("+"), F.concat(code, F.lit("+"), digits))
        .when(kind == "phone", F.concat(F.lit("1+1"), digits))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "name", F.concat(_gender(mention), F.lit(":"), F.lower(v)))
        .when((kind == "secret") & ~F.regexp_like(v, F.lit("^[0-9A-Fa-f]+$")), v)
        .otherwise(F.lower(v))
    )


def _bytes(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """64 keyed bytes."""
    inner = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, attempt.cast("string"), canon), 256)
    outer = F.sha2(F.concat(F.lit(key), inner), 512)
    return let(outer, lambda o: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(o, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.get(F.split(F.lit(",".join(values)), ","), (n % len(values)).cast("int"))


def _masked(value: Column, b: Column) -> Column:
    """Letters for letters, digits for digits."""

    def one(c: Column, i: Column) -> Column:
        n = F.get(b, i % 64)
        at = lambda chars: F.substring(F.lit(chars), (n % len(chars)) + 1, F.lit(1))
        return F.when(c.between("0", "9"), at("0123456789")).when(c.between("a", "z"), at("abcdefghijklmnopqrstuvwxyz")).when(c.between("A", "Z"), at("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _hexed(value: Column, b: Column) -> Column:
    """Hexadecimal digits for hexadecimal digits; the rest stays."""
    digit = lambda i: F.substring(F.lit("0123456789abcdef"), F.get(b, i % 64) % 16 + 1, F.lit(1))
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(F.regexp_like(c, F.lit("^[0-9a-f]$")), digit(i)).otherwise(c)), "")


def _mod97(text: Column) -> Column:
    """Remainder of a string of digits and capitals, A being 10 and Z 35."""
    step = lambda a, c: F.when(c.between("0", "9"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _iban(canon: Column, b: Column) -> Column:
    """The country stays, letters and digits of the account are drawn, the check digits follow from them."""
    country = F.substring(canon, 1, 2)
    finish = lambda own: F.concat(country, F.lpad((98 - _mod97(F.concat(own, country, F.lit("00")))).cast("string"), 2, "0"), own)
    return let(_masked(F.substring(canon, F.lit(5), F.length(canon)), b), finish)


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of an array of digits, the check digit last."""
    n = F.size(digits)
    turned = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(turned, F.lit(0), lambda a, d: a + d)


def _digits(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: c.cast("int"))


def _card(canon: Column, b: Column) -> Column:
    old = _digits(canon)
    new = lambda o: F.transform(o, lambda d, i: F.when(i == 0, d).otherwise(F.get(b, i) % 10))

    def checked(o: Column) -> Column:
        def fix(n: Column) -> Column:
            head = F.slice(n, F.lit(1), F.size(n) - 1)
            check = (10 - _luhn_sum(F.concat(head, F.array(F.lit(0)))) % 10) % 10
            return F.when(_luhn_sum(o) % 10 == 0, F.concat(head, F.array(check))).otherwise(n)

        return let(new(o), fix)

    return F.array_join(F.transform(let(old, checked), lambda d: d.cast("string")), "")


def _more(b: Column, attempt: Column) -> Column:
    """Letters that make the space larger: none at first, then one more an attempt."""
    letter = lambda k: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.get(b, (k + 31) % 64) % 26 + 1, F.lit(1))
    n = attempt - (STRICT_ATTEMPTS - 1)
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), letter), "")).otherwise(F.lit(""))


def _email(canon: Column, b: Column, attempt: Column) -> Column:
    local = F.substring_index(canon, "@", 1)
    labels = F.split(F.substring_index(canon, "@", -1), "\\.")
    front = F.when(F.size(labels) > 2, F.concat(F.array_join(F.slice(labels, F.lit(1), F.size(labels) - 2), "."), F.lit("."))).otherwise(F.lit(""))
    return F.concat(_more(b, attempt), _masked(F.concat(local, F.lit("@"), front), b), F.lit("example."), _pick(("com", "net", "org"), F.get(b, F.lit(63))))


def _name(canon: Column, b: Column, attempt: Column) -> Column:
    gender, name = F.substring(canon, 1, 1), F.substring(canon, F.lit(3), F.length(canon))
    words = F.split(name, " ")

    def made(script: str) -> Column:
        given = F.when(gender == "f", _pick(GIVEN["f", script], F.get(b, F.lit(0)))).otherwise(_pick(GIVEN["m", script], F.get(b, F.lit(0))))
        syllable = lambda k: _pick(SYLLABLES[script], F.get(b, k))
        longer = F.array_join(F.transform(F.sequence(F.lit(4), F.greatest(F.lit(4), F.least(attempt, F.lit(MORE_SYLLABLES)) + 3)), syllable), "")
        surname = F.concat(*(syllable(F.lit(k)) for k in (1, 2, 3)), F.when(attempt > 0, longer).otherwise(F.lit("")))
        more = F.when(F.size(words) > 1, F.concat(F.lit(" "), surname)).otherwise(F.lit(""))
        known = F.get(words, 0).isin(*(n.lower() for (_, s), names in GIVEN.items() if s == script for n in names))
        return F.lower(F.when((F.size(words) > 1) | (known & (attempt < STRICT_ATTEMPTS)), F.concat(given, more)).otherwise(surname))

    return F.concat(gender, F.lit(":"), F.when(F.regexp_like(name, F.lit(r"^\p{IsCyrillic}")), made("cyrillic")).otherwise(made("latin")))


def core(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """Canonical form of the surrogate."""

    def of(b: Column) -> Column:
        code, number = F.substring_index(canon, "+", 1).cast("int"), F.substring_index(canon, "+", -1)
        phone = F.concat(F.substring_index(canon, "+", 1), F.lit("+"), F.substring(number, F.lit(1), code), _masked(F.substring(number, code + 1, F.lit(32)), b))
        ip = F.concat_ws(".", *((F.get(b, F.lit(k)) % 254 + 1).cast("string") for k in range(4)))
        plain = F.when(canon.startswith("AKIA"), F.concat(F.lit("AKIA"), _masked(F.substring(canon, F.lit(5), F.length(canon)), b))).when(F.regexp_like(canon, F.lit("^[0-9a-f]++$")), _hexed(canon, b)).otherwise(_masked(canon, b))
        plain = F.when(F.regexp_like(canon, F.lit("^AKIA[0-9A-Z]{16}$")), plain).otherwise(F.concat(plain, _more(b, attempt)))
        return (
            F.when(kind == "email", _email(canon, b, attempt)).when(kind == "phone", phone).when(kind == "card", _card(canon, b)).when(kind == "ip", ip).when(kind == "ip6", _hexed(canon, b))
            .when(kind == "iban", _iban(canon, b)).when(kind == "ssn", _masked(canon, b)).when(kind == "name", _name(canon, b, attempt)).otherwise(plain)
        )

    return let(_bytes(key, kind, canon, attempt), of)


def render(mention: Column, kind: Column, surrogate: Column) -> Column:
    """A surrogate in the layout and case of the mention."""
    number = F.substring_index(surrogate, "+", -1)
    # A telephone number without country code shows the digits after it.
    signs = F.when((kind == "phone") & ~mention.startswith("+"), F.substring(number, F.lit(2), F.length(number))).otherwise(number)
    own = lambda c: c.between("0", "9") | ((kind == "iban") & c.between("A", "Z"))
    laid = F.aggregate(
        F.split(mention, ""),
        F.struct(F.lit("").alias("s"), F.lit(0).alias("k")),
        lambda a, c: F.when(own(c), F.struct(F.concat(a["s"], F.substring(signs, a["k"] + 1, F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k"))),
        lambda a: a["s"],
    )

    def around(v: Column) -> Column:
        plain = F.when(kind == "name", F.initcap(F.substring(surrogate, F.lit(3), F.length(surrogate)))).otherwise(surrogate)
        cased = F.when((F.upper(v) == v) & (F.lower(v) != v) & (kind != "name"), F.upper(plain)).otherwise(plain)
        # The value ends the mention but for a secret's punctuation.
        at = F.length(mention) - F.when(kind == "secret", F.length(F.regexp_replace(mention, f"^{_KEYWORD}", ""))).otherwise(F.length(v))
        return F.concat(F.substring(mention, F.lit(1), at), cased, F.substring(mention, at + F.length(v) + 1, F.length(mention)))

    return F.when(kind.isin("phone", "card", "ssn", "iban"), laid).otherwise(let(_value(mention, kind), around))


def mentions(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(GATE)), F.regexp_extract_all(text, F.lit(UNION), 0)).otherwise(F.array().cast("array<string>"))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct (kind, canon) of all texts."""
    m = docs.select(F.explode(mentions(F.col(text_col))).alias("m"))
    return m.select(type_of(F.col("m")).alias("kind"), "m").select("kind", canonical(F.col("m"), F.col("kind")).alias("canon")).distinct()


def exceptions(found: DataFrame, key: str = KEY) -> DataFrame | None:
    """(kind, canon, surrogate) of the entities whose first surrogate collides; None if there are none.

    An entity keeps a candidate only if no real entity looks like it, no settled entity has it, and no lesser
    entity of the same round has it.
    """
    real = found.select("kind", F.col("canon").alias("surrogate"))
    pending, settled = found, None
    for attempt in range(MOST_ATTEMPTS):
        cand = materialise(pending.select("kind", "canon", core(key, F.col("kind"), F.col("canon"), F.lit(attempt)).alias("surrogate")), "pii-drawn")
        taken = real if settled is None else real.unionByName(settled.select("kind", "surrogate"))
        winners = cand.join(taken, ["kind", "surrogate"], "left_anti").groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        good = winners.select("kind", "canon", "surrogate")
        losers = materialise(pending.join(good, ["kind", "canon"], "left_anti").select("kind", "canon"), "pii-losers")
        if attempt == 0:
            if losers.isEmpty():
                return None
            redrawn = losers
        settled = materialise(good if settled is None else settled.unionByName(good), "pii-settled")
        if losers.isEmpty():
            return settled.join(redrawn, ["kind", "canon"], "left_semi")
        pending = losers
    raise RuntimeError("surrogates still collide; the space of a type is used up")


def replace(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text", report: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text_col``; ``report`` names an array column of the types found, in text order."""
    odd = exceptions(materialise(entities(docs, text_col), "pii-entities"), key)
    own = docs.columns
    special = free_name(docs, "special")
    if odd is not None:
        wanted, d_id = free_name(docs, "wanted_id"), F.col(id_col)
        m = docs.select(d_id.alias(wanted), F.explode(mentions(F.col(text_col))).alias("m")).select(wanted, type_of(F.col("m")).alias("kind"), "m")
        hits = m.select(wanted, "kind", canonical(F.col("m"), F.col("kind")).alias("canon")).distinct().join(odd, ["kind", "canon"])
        maps = hits.groupBy(wanted).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\u0001", "kind", "canon"), "surrogate"))).alias(special))
        docs = docs.join(maps, d_id.eqNullSafe(F.col(wanted)), "left").drop(wanted)

    def swap(mention: Column) -> Column:
        def kinded(kind: Column) -> Column:
            def with_canon(canon: Column) -> Column:
                made = core(key, kind, canon, F.lit(0))
                if odd is not None:
                    made = F.coalesce(F.try_element_at(F.col(special), F.concat_ws("\u0001", kind, canon)), made)
                return let(made, lambda s: F.struct(render(mention, kind, s).alias("text"), kind.alias("kind")))

            return let(canonical(mention, kind), with_canon)

        return let(type_of(mention), kinded)

    text = F.col(text_col)

    def rebuilt(found: Column) -> Column:
        gaps = F.split(text, UNION, -1)
        whole = lambda new: F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(new, i)["text"], F.lit("")))), "")
        return let(F.transform(found, swap), lambda new: F.struct(whole(new).alias("text"), F.transform(new, lambda n: n["kind"]).alias("kinds")))

    same = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    done = free_name(docs, "done")
    out = docs.withColumn(done, let(mentions(text), lambda found: F.when(F.size(found) > 0, rebuilt(found)).otherwise(same)))
    columns = [F.col(f"{done}.text").alias(c) if c == text_col else F.col(c) for c in own]
    return out.select(*columns, *([F.col(f"{done}.kinds").alias(report)] if report else []))


def replaced(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text, n_entities and the number of entities of each type."""
    d = docs.select("doc_id", "text")
    out = replace(d, key, report="kinds")
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("bigint")
    total = reduce(lambda a, b: a + b, (count(k) for k in PATTERNS))
    return out.select("doc_id", "text", total.alias("n_entities"), *(count(k).alias(f"n_{k}") for k in PATTERNS))
