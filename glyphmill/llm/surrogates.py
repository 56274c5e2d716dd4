"""PII surrogates with DataFrame functions alone.

Detected entities are replaced by keyed surrogates of their own kind and format. Nearly all pass through one keyed
permutation (``permuted``): a Feistel network over mixed radix, whose halves shift each other's characters within
their classes, with one step of the first free character between the network and its inverse. So, for each layout, it
is a bijection and never gives an entity back as it was:

* phones, national numbers, cards, IBANs and addresses keep their layout (blanks, dots, brackets). A phone keeps its
  country code, told from its digits by the table of code lengths and never from its layout, and the first digit after it (in the
  plan of code 1 also that of the exchange). A card keeps its first digit and whether its check digit fits, an IBAN its country and whether its check
  digits fit, an IPv4 address its first octet (two where private blocks begin with it), an IPv6 address
  its first group (it's written in full);
* secrets and access keys keep the class of every character: digits, letters by script and case, other marks as they are.
  Hexadecimal ones stay hexadecimal. A secret with fewer than ROOM letters and digits has no room for that and becomes a
  keyed token instead;
* an e-mail address keeps its shape below the reserved domain example.org;
* names keep title, script, case, and which of their letters are vowels; a given name gets an ending of its gender, which the
  title tells or else the name. Each word of a name maps on its own, so "Mr Ito" and "Mr Ken Ito" share their family
  name. The names that a title introduces are replaced in the rest of the same text too, whole or family name alone.

A surrogate depends on the key and the canonical entity (the digits of a phone, the lower-cased address) only, so
coreference holds across the corpus and across layouts. A check over all distinct entities compares canonical
surrogates: where two entities share one (which the permutations exclude, and tokens and hexadecimal secrets nearly), all
but the least get a token of a whole SHA-256 digest, so one pass suffices.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

KEY = "glyphmill-surrogates-1"
ROUNDS = 4
ROOM = 6
TOKEN_DIGITS = 24
EMPTY = "array<string>"
#: Titles by gender (m, f, or x for either), given names that tell a gender, and endings of given names by script.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "κ"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "г-жа", "κα"], "x": ["Dr", "Prof"]}
GIVEN = {
    "m": "adrian bruno carl daniel emil felix gabriel hugo ivan jonas leo martin luca andrea joshua никита илья лука савва фома νίκος",
    "f": "alice agnes carmen dolores edith elisabeth elizabeth grace helen ingrid irene judith karen margaret pilar ruth susan любовь",
}
ENDINGS = {"latin": ("us", "ia"), "cyrillic": ("ий", "ия"), "greek": ("ιος", "ία")}
#: Alphabets whose characters stand for each other; those of names part vowels from consonants.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUSSIAN, GREEK = "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýþÿœšž"
#: For each mode of ``recast`` its alphabets. Octets of addresses travel as characters of a private block.
MODES = {
    "any": [DIGITS, LOWER, UPPER, RUSSIAN, RUSSIAN.upper(), GREEK, GREEK.upper(), ACCENTED, ACCENTED.upper()],
    "hex": [DIGITS, "abcdef", "ABCDEF"],
    "name": ["aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûüýÿœ", "çñšžčřďťňłđğşżźśćńß", "аеёиоуыэюяіїє", "бвгджзйклмнпрстфхцчшщ", "ъь", "αεηιουω", "άέήίόύώϊϋ", "βγδζθκλμνξπρσςτφχψ"],
}
OCTETS = 0xE000
#: Blocks of scripts without case: first code point and size (Hebrew, Arabic, kana, Han, Hangul).
BLOCKS = [(0x5D0, 27), (0x621, 26), (0x641, 10), (0x3041, 86), (0x30A1, 90), (0x4E00, 20992), (0xAC00, 11172), (OCTETS, 256)]
#: Country calling codes of one and of two digits; all others have three.
ONE_DIGIT, TWO_DIGITS = "1 7".split(), "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_GROUP = "[0-9a-fA-F]{1,4}"
_NAME = r"\p{Lu}(?:[\p{L}\p{M}]++(?:['’-][\p{L}\p{M}]++)*+|['’][\p{L}\p{M}]++)"
#: Kinds in order of preference; each pattern begins with a lookbehind, so a long word is tried once.
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "access": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![0-9A-Za-z])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])|(?<=(?:password|passwd|secret|token)[ ]?[=:][ ]?[\"']?)[^\s\"'<]{6,}+",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?=(?:[ ]?[A-Z]{0,4}[0-9]){7})(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip6": rf"(?<![0-9A-Za-z:.])(?=[0-9a-fA-F:]*[0-9])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}}|::(?:{_GROUP}:){{0,6}}{_GROUP}|(?:{_GROUP}:){{2,7}}:)(?![0-9A-Za-z:])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9])(?!\.[0-9])",
    "card": r"(?<![0-9-])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9])\+[0-9]{8,15}(?![0-9])|(?<![0-9A-Za-z.,+-])[2-9][0-9]{2}[2-9][0-9]{6}(?![0-9A-Za-z]|[.,-][0-9])",
    "name": rf"(?<![\p{{L}}])(?:{_TITLE})\.?[ ]{_NAME}(?:[ ](?!(?:{_TITLE})\.?[ ])(?:\p{{Lu}}\.[ ])?{_NAME}){{0,2}}",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every match of PATTERN holds a digit, an at sign or one of these; looking for them first is cheap.
SIGNS = ["AKIA", "password", "passwd", "secret", "token", "Mr", "Ms", "Miss", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Mlle", "Señor", "Sr", "Dr", "Prof", "г-", "κ"]


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, evaluating ``value`` once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def kind_of(entity: Column) -> Column:
    kind = F.lit("secret")
    for name in reversed([k for k in PATTERNS if k != "secret"]):
        kind = F.when(entity.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(kind)
    return kind


def digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)


def only(entity: Column, inside: str) -> Column:
    return F.regexp_replace(entity, f"[^{inside}]", "")


# -- the keyed permutation -------------------------------------------------------------------------


def permuted(values: Column, sizes: Column, key: str, tweak: Column) -> Column:
    """Another vector of numbers below ``sizes``: for each key, tweak and sizes a bijection without fixed points. It is its
    own kind of no-op only if no size is above 1, when ``values`` comes back."""
    half = F.floor(F.size(values) / 2).cast("int")
    first_free = F.array_position(F.transform(sizes, lambda n: n > 1), True).cast("int") - 1

    def shifted(state: Column, turn: Column, sign: Column) -> Column:
        left = turn % 2 == 0
        other = F.array_join(F.transform(F.when(left, F.slice(state, half + 1, F.size(state))).otherwise(F.slice(state, 1, half)), lambda v: v.cast("string")), ",")
        seed = F.concat_ws("\x1f", F.lit(key), tweak, turn.cast("string"), other)
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(state) / 16).cast("int")), lambda b: F.sha2(F.concat(seed, F.lit("\x1f"), b.cast("string")), 256))
        drawn = lambda h, i: F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return bind(F.array_join(blocks, ""), lambda h: F.transform(state, lambda v, i: F.when((i < half) == left, F.pmod(v + sign * drawn(h, i), F.element_at(sizes, i + 1))).otherwise(v)))

    def step(state: Column, t: Column) -> Column:
        stepped = F.transform(state, lambda v, i: F.when(i == first_free, F.pmod(v + 1, F.element_at(sizes, i + 1))).otherwise(v))
        return F.when(t < ROUNDS, shifted(state, t, F.lit(1))).when(t == ROUNDS, stepped).otherwise(shifted(state, 2 * ROUNDS - t, F.lit(-1)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS)), values, step)


def cells(text: Column, mode: Column) -> Column:
    """For each character ``c`` of a text its place ``v`` among the ``n`` that stand for each other (n = 1: none), and
    ``at``, where they begin: in all alphabets joined (from 1), or, negative, in Unicode."""
    joined, starts, begins, sizes = {}, {}, [], []
    for name, alphabets in MODES.items():
        joined[name], starts[name] = "".join(alphabets), len(begins)
        for alphabet in alphabets:
            begins += [len(begins) + 1] * len(alphabet)
            sizes += [len(alphabet)] * len(alphabet)
    by_mode = lambda of: F.when(mode == "name", F.lit(of["name"])).when(mode == "hex", F.lit(of["hex"])).otherwise(F.lit(of["any"]))
    told = lambda numbers, q: F.ascii(F.substring(F.lit("".join(map(chr, numbers))), q, F.lit(1)))
    cell = lambda c, v, n, at: F.struct(c.alias("c"), v.cast("int").alias("v"), n.cast("int").alias("n"), at.cast("int").alias("at"))

    def one(c: Column) -> Column:
        code = F.ascii(c)
        made = cell(c, F.lit(0), F.lit(1), F.lit(0))
        for first, size in BLOCKS:
            made = F.when(code.between(first, first + size - 1), cell(c, code - first, F.lit(size), F.lit(-first))).otherwise(made)
        far = F.when((code >= BLOCKS[0][0]) & (mode == "any"), made).otherwise(cell(c, F.lit(0), F.lit(1), F.lit(0)))
        return bind(F.instr(by_mode(joined), c), lambda p: F.when(p > 0, bind(p + by_mode(starts), lambda q: bind(told(begins, q), lambda at: cell(c, q - at, told(sizes, q), at)))).otherwise(far))

    return F.transform(F.split(text, ""), one)


def layout_of(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda x: F.when(x["n"] > 1, F.concat(F.lit("\x1e"), x["at"].cast("string"))).otherwise(x["c"])), "")


def recast(text: Column, key: str, mode: Column, tweak: Column) -> Column:
    """``new``: ``text`` with each character permuted within its alphabet of this mode (other characters stay), and ``room``: how
    many characters could change."""
    whole = F.lit("".join("".join(alphabets) for alphabets in MODES.values()))

    def letter(x: Column, v: Column) -> Column:
        far = F.decode(F.unhex(F.lpad(F.hex(v - x["at"]), 4, "0")), "UTF-16BE")
        return F.when(x["n"] == 1, x["c"]).when(x["at"] > 0, F.substring(whole, x["at"] + v, F.lit(1))).otherwise(far)

    def made(of: Column) -> Column:
        new = permuted(F.transform(of, lambda x: x["v"]), F.transform(of, lambda x: x["n"]), key, F.concat(tweak, F.lit("\x1d"), layout_of(of)))
        return F.struct(F.array_join(F.zip_with(of, new, letter), "").alias("new"), F.size(F.filter(of, lambda x: x["n"] > 1)).alias("room"))

    return F.when(F.length(text) > 0, bind(cells(text, mode), made)).otherwise(F.struct(text.alias("new"), F.lit(0).alias("room")))


def filled(entity: Column, new: Column, inside: str) -> Column:
    """``entity`` with its characters in the class ``inside``, in order, replaced by those of ``new``."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    step = lambda s, c: F.when(c.rlike(f"[{inside}]"), F.struct((s["at"] + 1).alias("at"), F.concat(s["out"], F.substring(new, s["at"], F.lit(1))).alias("out"))).otherwise(F.struct(s["at"].alias("at"), F.concat(s["out"], c).alias("out")))
    return F.aggregate(F.split(entity, ""), start, step)["out"]


# -- kinds -----------------------------------------------------------------------------------------


def tail(text: Column, begin: Column | int) -> Column:
    """``text`` from the character ``begin`` (from 1) on."""
    return F.substring(text, F.lit(begin) if isinstance(begin, int) else begin, F.length(text))


def code_length(digits: Column) -> Column:
    """Of a country calling code at the beginning of ``digits``."""
    return F.when(F.substring(digits, 1, 1).isin(ONE_DIGIT), 1).when(F.substring(digits, 1, 2).isin(TWO_DIGITS), 2).otherwise(3)


def phone_digits(entity: Column) -> Column:
    """``+`` and digits with the country code, or ``n`` and digits where there is none: ten digits, and eleven that begin
    with 1, are numbers of the plan of code 1, however they're written."""
    return bind(only(entity, "0-9"), lambda d: F.when(entity.startswith("+"), F.concat(F.lit("+"), d)).when(F.length(d) == 10, F.concat(F.lit("+1"), d)).when((F.length(d) == 11) & d.startswith("1"), F.concat(F.lit("+"), d)).otherwise(F.concat(F.lit("n"), d)))


def held_digits(known: Column) -> Column:
    """How many of a phone's first digits stay: those of its country code, and one more."""
    return F.when(known.startswith("+"), code_length(tail(known, 2))).otherwise(0) + 1


def in_plan_1(known: Column) -> Column:
    """Whether a phone is a whole number of the plan of code 1, in which area and exchange don't begin with 0 or 1."""
    return known.startswith("+1") & (F.length(known) == 12)


def check_digit(body: Column) -> Column:
    """The Luhn digit that fits a number without its last digit."""
    values = F.transform(F.reverse(F.split(body, "")), lambda c, i: bind(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.pmod(10 - F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10, F.lit(10))


def card(digits: Column, new: Column) -> Column:
    """``digits`` with ``new`` between the first and the last, which stays as far from the one that fits as it was."""
    n = F.length(digits)
    off = F.substring(digits, n, F.lit(1)).cast("int") - check_digit(F.substring(digits, F.lit(1), n - 1))
    return bind(F.concat(F.substring(digits, 1, 1), new), lambda b: F.concat(b, F.pmod(check_digit(b) + off, F.lit(10)).cast("string")))


def mod97(text: Column) -> Column:
    """The remainder by 97 of a text's digits and letters (A = 10 ... Z = 35) read as one number."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def iban_fits(known: Column) -> Column:
    return mod97(F.concat(tail(known, 5), F.substring(known, 1, 4))) == 1


def iban(known: Column, new: Column) -> Column:
    """The country with ``new``, before which check digits that fit come if those of ``known`` did."""
    country = F.substring(known, 1, 2)
    return F.concat(country, F.when(iban_fits(known), F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")).otherwise(""), new)


def ip6_groups(entity: Column) -> Column:
    """An IPv6 address as its 32 lower-case hexadecimal digits (more if it had too many groups)."""
    groups = lambda part: F.transform(F.filter(F.split(part, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))
    sides = F.split(F.lower(entity), "::", 2)
    left, right = groups(F.element_at(sides, 1)), groups(F.coalesce(F.try_element_at(sides, F.lit(2)), F.lit("")))
    return F.array_join(F.concat(left, F.array_repeat(F.lit("0000"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))), right), "")


def octets_held(entity: Column) -> Column:
    """How many of an IPv4 address's octets stay: two where the second tells the block."""
    return F.when(entity.rlike(r"^(?:192|172|169)\."), 2).otherwise(1)


def octet_letters(entity: Column, held: Column) -> Column:
    """The other octets as characters of the private block."""
    free = F.transform(F.slice(F.split(entity, r"\."), held + 1, 4), lambda o: F.decode(F.unhex(F.hex(o.cast("int") + OCTETS)), "UTF-16BE"))
    return F.array_join(free, "")


def ip4(entity: Column, held: Column, new: Column) -> Column:
    kept = F.slice(F.split(entity, r"\."), 1, held)
    return F.array_join(F.concat(kept, F.transform(F.split(new, ""), lambda c: (F.ascii(c) - OCTETS).cast("string"))), ".")


def title_of(entity: Column) -> Column:
    return F.regexp_extract(entity, rf"^((?:{_TITLE})\.?[ ])", 1)


def gender_of(title: Column, given: Column) -> Column:
    """Told by the title, or else by the given name itself."""
    bare, said = F.regexp_replace(F.trim(title), r"\.$", ""), F.lower(given)
    named = F.when(said.isin(GIVEN["f"].split()), "f").when(said.isin(GIVEN["m"].split()), "m").when(said.rlike("(?:a|ie|elle|ine|а|я|α|η|ά|ή)$"), "f").otherwise("m")
    return F.when(bare.isin(TITLES["m"]), "m").when(bare.isin(TITLES["f"]), "f").otherwise(named)


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def ending(word: Column, gender: Column) -> Column:
    made = F.lit("")
    for script, (m, f) in ENDINGS.items():
        made = F.when(script_of(word) == script, F.when(gender == "f", f).otherwise(m)).otherwise(made)
    return made


def role_of(i: Column, n: Column, gender: Column) -> Column:
    return F.when(i == n - 1, F.lit("family")).when(i == 0, F.concat(F.lit("given"), gender)).otherwise(F.lit("middle"))


def person(words: Column, gender: Column, made: Column, key: str) -> Column:
    """A name from its words' surrogates ``made``, each in the case of the word it replaces, the given name with its
    gender's ending. A word without a letter of a known alphabet becomes one of keyed letters."""
    n = F.size(words)

    def one(w: Column, i: Column) -> Column:
        new, room = F.element_at(made, i + 1)["new"], F.element_at(made, i + 1)["room"]
        drawn = F.initcap(F.translate(F.substring(digest(key, role_of(i, n, gender), F.lower(w)), 1, TOKEN_DIGITS), DIGITS, "ghijklmnop"))
        cased = F.array_join(F.zip_with(F.split(new, ""), F.split(w, ""), lambda x, y: F.when(y.rlike(r"\p{Lu}"), F.upper(x)).otherwise(x)), "")
        said = F.when(room == 0, drawn).when(F.length(new) == F.length(w), cased).otherwise(F.initcap(new))
        return F.concat(said, F.when((i == 0) & (n > 1), ending(w, gender)).otherwise(""))

    return F.array_join(F.transform(words, one), " ")


def words_of(entity: Column) -> Column:
    return F.split(F.substring(entity, F.length(title_of(entity)) + 1, F.length(entity)), " ")


def canonical(entity: Column, kind: Column) -> Column:
    """What coreferent spellings share."""
    person_ = bind(words_of(entity), lambda w: F.concat_ws(" ", F.when(F.size(w) > 1, gender_of(title_of(entity), F.element_at(w, 1))), F.lower(F.array_join(w, " "))))
    return (
        F.when(kind.isin("card", "national"), only(entity, "0-9"))
        .when(kind == "phone", phone_digits(entity))
        .when(kind == "iban", only(entity, "A-Z0-9"))
        .when(kind == "ip6", ip6_groups(entity))
        .when(kind == "email", F.lower(entity))
        .when(kind == "name", person_)
        .otherwise(entity)
    )


def known_as(entity: Column) -> Column:
    """Kind and canonical form: equal for coreferent entities."""
    return bind(kind_of(entity), lambda kind: F.concat_ws("\x1f", kind, canonical(entity, kind)))


def surrogate(entity: Column, key: str = KEY, losers: Column | None = None, people: Column | None = None) -> Column:
    """The surrogate of one entity. ``losers``: entities (as ``known_as``) that the collision check gave tokens; ``people``:
    untitled names (as ``introduced``) that are entities here."""
    piece = lambda t, mode, *tweak: F.struct(t.alias("t"), F.lit(mode).alias("mode") if isinstance(mode, str) else mode.alias("mode"), F.concat(*(F.lit(x) if isinstance(x, str) else x for x in tweak), F.lit("")).alias("tweak"))

    def parts_of(kind: Column, known: Column, words: Column, gender: Column) -> Column:
        """What of the entity is permuted."""
        one = lambda *x: F.array(piece(*x))
        fits, held = iban_fits(known), held_digits(known)
        return (
            F.when(kind == "email", one(known, "any", "email"))
            .when(kind == "access", one(tail(entity, 5), "any", "access"))
            .when(kind == "iban", one(F.when(fits, tail(known, 5)).otherwise(tail(known, 3)), "any", "iban", F.substring(known, 1, 2), fits.cast("string")))
            .when(kind == "ip6", one(tail(known, 5), "hex", "ip6", F.substring(known, 1, 4)))
            .when(kind == "ip", one(octet_letters(entity, octets_held(entity)), "any", "ip", F.array_join(F.slice(F.split(entity, r"\."), 1, octets_held(entity)), ".")))
            .when(kind == "card", one(F.substring(known, F.lit(2), F.length(known) - 2), "any", "card", F.substring(known, 1, 1)))
            .when(kind == "national", one(known, "any", "national"))
            .when((kind == "phone") & in_plan_1(known), one(F.concat(F.substring(known, 4, 2), tail(known, 7)), "any", "phone", F.substring(known, 1, 3), F.substring(known, 6, 1)))
            .when(kind == "phone", one(tail(known, held + 2), "any", "phone", F.substring(known, F.lit(1), held + 1)))
            .when(kind == "name", F.transform(words, lambda w, i: piece(F.lower(w), "name", role_of(i, F.size(words), gender))))
            .otherwise(one(entity, F.when(entity.rlike("^(?=[a-fA-F]*[0-9])[0-9a-fA-F]{16,}$"), "hex").otherwise("any"), "secret"))
        )

    def put(kind: Column, known: Column, title: Column, words: Column, gender: Column, made: Column) -> Column:
        """The entity's surrogate from what its parts became."""
        new = F.element_at(made, 1)["new"]
        plan_1 = F.concat(F.substring(known, 2, 2), F.substring(new, 1, 2), F.substring(known, 6, 1), tail(new, 3))
        digits = F.when(in_plan_1(known), plan_1).otherwise(F.concat(F.substring(known, F.lit(2), held_digits(known)), new))
        made_ = (
            F.when(kind == "email", F.concat(new, F.lit(".example.org")))
            .when(kind == "access", F.concat(F.lit("AKIA"), new))
            .when(kind == "iban", filled(entity, iban(known, new), "A-Z0-9"))
            .when(kind == "ip6", F.regexp_replace(F.concat(F.substring(known, 1, 4), new), "(....)(?!$)", "$1:"))
            .when(kind == "ip", ip4(entity, octets_held(entity), new))
            .when(kind == "card", filled(entity, card(known, new), "0-9"))
            .when(kind == "national", filled(entity, new, "0-9"))
            # a country code that the entity doesn't write is left out
            .when(kind == "phone", filled(entity, tail(digits, F.length(digits) - F.length(only(entity, "0-9")) + 1), "0-9"))
            .when(kind == "name", F.concat(title, person(words, gender, made, key)))
            .when(F.element_at(made, 1)["room"] < ROOM, F.concat(F.lit("x"), F.substring(digest(key, F.lit("token"), entity), 1, TOKEN_DIGITS)))
            .otherwise(new)
        )
        if losers is None:
            return made_
        return F.when(F.array_contains(losers, F.concat_ws("\x1f", kind, known)), F.concat(F.lit("x"), digest(key, F.lit("again"), kind, known))).otherwise(made_)

    def whole(x: Column) -> Column:
        known = canonical(entity, x["kind"])
        return bind(known, lambda k: bind(F.transform(parts_of(x["kind"], k, x["words"], x["gender"]), lambda p: recast(p["t"], key, p["mode"], p["tweak"])), lambda made: put(x["kind"], k, x["title"], x["words"], x["gender"], made)))

    def titled(title: Column) -> Column:
        words = F.split(tail(entity, F.length(title) + 1), " ")
        return bind(words, lambda w: F.struct(kind_of(entity).alias("kind"), title.alias("title"), w.alias("words"), gender_of(title, F.element_at(w, 1)).alias("gender")))

    mine = bind(title_of(entity), titled)
    if people is not None:
        said = F.try_element_at(F.filter(people, lambda p: p["said"] == entity), F.lit(1))
        bare = bind(said, lambda p: F.when(p.isNotNull(), F.struct(F.lit("name").alias("kind"), F.lit("").alias("title"), p["words"].alias("words"), p["gender"].alias("gender"))))
        mine = F.coalesce(bare, mine)
    return bind(mine, whole)


# -- texts -----------------------------------------------------------------------------------------


def found_in(text: Column) -> Column:
    """The entities of a text, in order and as written; none for null."""
    signs = text.rlike("[0-9@]")
    for sign in SIGNS:
        signs = signs | F.contains(text, F.lit(sign))
    return F.coalesce(F.when(signs, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))), F.array().cast(EMPTY))


def introduced(found: Column) -> Column:
    """For each titled name among the entities its untitled forms ``said`` (whole, first and last word, family name), with their
    ``words`` and the ``gender``."""
    titled = F.filter(found, lambda e: e.rlike(rf"^(?:{_TITLE})\.?[ ]\p{{Lu}}"))

    def forms(e: Column, w: Column) -> Column:
        gender, family = gender_of(title_of(e), F.element_at(w, 1)), F.element_at(w, -1)
        form = lambda ws: F.struct(F.array_join(ws, " ").alias("said"), ws.alias("words"), gender.alias("gender"))
        return F.array_distinct(F.array(form(w), form(F.when(F.size(w) > 1, F.array(F.element_at(w, 1), family)).otherwise(w)), form(F.array(family))))

    return F.flatten(F.transform(titled, lambda e: bind(words_of(e), lambda w: forms(e, w))))


def any_of(said: Column) -> Column:
    """A pattern of any of these names as whole words, the longest first."""
    longest = F.transform(F.reverse(F.array_sort(F.transform(F.array_distinct(said), lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))), lambda x: x["s"])
    return F.concat(F.lit(r"(?<![\p{L}\p{M}])(?:"), F.array_join(F.transform(longest, lambda s: F.replace(s, F.lit("."), F.lit("\\."))), "|"), F.lit(r")(?![\p{L}\p{M}])"))


def losers_among(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``known`` (as ``known_as``) of the entities that share the canonical surrogate of a lesser one. ``entities``: distinct,
    in column ``entity``; dealt evenly, as few rows can be much work."""
    spread = entities.repartition(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("entity"))
    made = spread.select("entity", kind_of(F.col("entity")).alias("kind")).select("kind", canonical(F.col("entity"), F.col("kind")).alias("canonical"), surrogate(F.col("entity"), key).alias("new"))
    shown = F.when(F.col("kind") == "name", F.lower(F.regexp_replace("new", rf"^(?:{_TITLE})\.?[ ]", ""))).otherwise(canonical(F.col("new"), F.col("kind")))
    compared = written(made.select(F.concat_ws("\x1f", "kind", "canonical").alias("known"), shown.alias("shown")), "pii-surrogates")
    least = compared.groupBy("shown").agg(F.min("known").alias("first"), F.max("known").alias("last")).where("first <> last")
    return written(compared.join(least, "shown").where("known <> first").select("known").distinct(), "pii-losers")


def replace_entities(df: DataFrame, key: str = KEY, *, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``df`` with the entities in ``text_col`` replaced, all other columns kept whatever their names; ``count_col``, if
    named, gets the number of replaced entities (an existing column of that name is replaced).

    Null stays null (count 0); texts without entities, empty ones too, are unchanged; ids aren't read. Rows that repeat
    get the same text. An empty table gives no rows. Only the distinct entities are shuffled, for the collision check, and, if
    it finds any, once the documents' texts.
    """
    columns = [c for c in df.columns if c not in (text_col, count_col)]
    read = df.select(F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)), F.lit(0).alias("none")).alias("row"), F.col(f"`{text_col}`").alias("whole"))
    entities = read.select(F.explode(found_in(F.col("whole"))).alias("entity")).distinct()
    lost = losers_among(entities, key)
    held, losers = read.withColumn("found", found_in(F.col("whole"))), None
    if lost.limit(1).count():
        each = held.where(F.size("found") > 0).select("whole", F.explode("found").alias("entity")).distinct().withColumn("known", known_as(F.col("entity")))
        theirs = each.join(lost, "known").groupBy(F.col("whole").alias("theirs")).agg(F.collect_set("known").alias("losers"))
        held, losers = held.join(theirs, F.col("whole") == F.col("theirs"), "left").withColumn("losers", F.coalesce("losers", F.array().cast(EMPTY))), F.col("losers")
    held = held.withColumn("people", introduced(F.col("found")))
    more = F.when(F.size("people") > 0, F.concat(F.lit(PATTERN + "|"), any_of(F.transform("people", lambda p: p["said"]))))
    held = held.withColumn("pattern", more)
    held = held.withColumn("all", F.when(F.col("pattern").isNotNull(), F.regexp_extract_all("whole", F.col("pattern"), F.lit(0))).otherwise(F.col("found")))
    new = F.transform("all", lambda e: surrogate(e, key, losers, F.col("people")))
    parts = F.split("whole", F.coalesce("pattern", F.lit(PATTERN)), -1)
    text = F.when(F.size("all") > 0, F.array_join(F.zip_with(parts, F.concat(new, F.array(F.lit(""))), lambda p, s: F.concat(p, s)), "")).otherwise(F.col("whole"))
    made = {c: F.col(f"row.c{k}") for k, c in enumerate(columns)} | {text_col: text} | ({count_col: F.size("all").cast("long")} if count_col else {})
    return held.select(*(made[c].alias(c) for c in df.columns), *([made[count_col].alias(count_col)] if count_col and count_col not in df.columns else []))
