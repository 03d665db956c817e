"""Personal data replaced by keyed surrogates.

Entities are found by patterns, their forms are reduced to what they refer to (letters and digits in
lower case; the name parts of a person), and every referent gets one surrogate from a keyed hash, so
all its mentions stay the same referent wherever they occur. A surrogate keeps the kind: digits stay
digits, letters keep script and case, separators stay, host endings stay, octets keep their width, card
numbers their check digit, phones their leading zeros, and given names their gender; octets keep their width and other
kinds their length for the first `WIDER_AFTER` draws, after which a full space is widened. A person is found by a
title or a listed given name; the surname is then replaced wherever else the same text has it. Surrogates that two referents share, or that
occur as a referent in the corpus, are drawn again until all are distinct.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwatch.functions.shared import stage

# Titles and given names that tell a gender, by script.
MALE_TITLES = "Mr Herr Monsieur Señor Sr Don г-н господин Κος".split()
FEMALE_TITLES = "Mrs Ms Miss Frau Madame Mme Señora Sra Doña г-жа госпожа Κα".split()
LOUD_TITLES = "MR MRS HERR FRAU".split()  # the others are words in capitals, too
MALE_NAMES = (
    "James John Robert Michael William David Richard Thomas Daniel Paul Hans Peter Klaus Jürgen Wolfgang Pierre Jean "
    "Michel Louis Henri Carlos José Juan Luis Miguel Charles Joseph Mark George Edward Brian Kevin Steven Andrew "
    "Matthew Anthony Ali Ahmed Mohammed Omar Raj Arjun Rahul Wei Giovanni Marco Luca Antonio Stefan Andreas Иван Сергей Алексей Дмитрий Николай Γιώργος Νίκος Δημήτρης"
).split()
FEMALE_NAMES = (
    "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Karen Anna Emma Ursula Monika Petra Sabine Marie Claire "
    "Isabelle Sophie Camille María Carmen Ana Laura Lucía Alice Emily Margaret Barbara Nancy Lisa Helen Julia Rachel "
    "Olivia Priya Anjali Fatima Aisha Mei Yuki Giulia Francesca Chiara Katharina Birgit Heike Анна Мария Елена Ольга Наталья Μαρία Ελένη Κατερίνα"
).split()
# Syllables of invented names, by script, and endings by gender.
SYLLABLES = {
    "latin": "ba be bo da de di do fa fe ga ka ke la le li lo ma me mi mo na ne no ra re ri ro sa se ta".split(),
    "cyrillic": "ба бе во га да де ди жа за ка ко ла ле ли ло ма ме ми на не но ра ре ри ро са се та те ти".split(),
    "greek": "βα γα δα δε ζα θα κα κε λα λε λι λο μα με μι μο να νε νο πα ρα ρε ρι ρο σα σε τα τε τι το".split(),
}
ENDINGS = {
    "male": {"latin": "rt n s k".split(), "cyrillic": "н р с м".split(), "greek": "ς".split()},
    "female": {"latin": "na la ra ia".split(), "cyrillic": "на ла ра ия".split(), "greek": "να λα ρα ια".split()},
    "surname": {"latin": "ner mann son ez".split(), "cyrillic": "ко ич ук ян".split(), "greek": "δης κος πος της".split()},
}



def any_of(words: list[str]) -> str:
    """A pattern of any of the words, by their first letters, so that few of them are tried at a place."""
    heads: dict[str, list[str]] = {}
    for word in dict.fromkeys(words):
        heads.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{head}(?:{'|'.join(rest)})" for head, rest in heads.items())


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_WORD = r"\p{Lu}[\p{Ll}\p{M}]++(?:\p{Lu}[\p{Ll}\p{M}]++)?"
# Inner capitals, an apostrophe after the first letter, a hyphen; or capitals throughout.
_NAME = rf"(?:(?:\p{{Lu}}['’])?{_WORD}(?:-{_WORD})?|\p{{Lu}}['’]?\p{{Lu}}{{2,}}+(?:-\p{{Lu}}{{2,}}+)?)"
_HEX = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,24}(?![\p{L}\p{N}])",
    "iban": r"\b(?=[A-Z]{2}(?:[A-Z ]{0,6}\d){10})[A-Z]{2}\d{2}(?:(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})\b",
    # 7 to 15 digits after a plus; a code in brackets; 3-3-4 digits; a leading zero and groups (but no date, ssn or card).
    "phone": r"(?<![\d+])\+(?:[ ./-]?\(?\d\)?){6,14}[ ./-]?\d(?!\d)"
    r"|(?<!\d)\(\d{2,5}\)(?:[ ./-]?\d){5,11}(?!\d)"
    r"|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])"
    r"|(?<![\d.,/:+-])(?!\d{2}[./-]\d{2}[./-]\d{4}(?!\d)|\d{3}-\d{2}-\d{4}(?!\d)|\d{4}(?:[ -]\d{4}){3}(?!\d))"
    r"(?=0\d{1,4}[ ./-]\d{2})0(?:[ ./-]?\d){6,14}(?!\d)"
    # A run of bare digits only where a word says so.
    r"|(?<=\b(?i:phone|tel|telephone|call|mobile|cell|fax|dial)[.:]? {0,2})\d{7,14}(?!\d)",
    "card": r"(?<![\d.-])(?:\d{15,16}|\d{4}(?:[ -]\d{4}){3})(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ip6": rf"(?<![\w:.])(?=[A-Fa-f:]{{0,39}}+\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|:(?::{_HEX}){{1,7}})(?![\w:])",
    # The class of first letters is looked at before anything else, as it fails almost everywhere.
    "person": rf"(?=[{''.join(sorted({w[0] for w in MALE_TITLES + FEMALE_TITLES + MALE_NAMES + FEMALE_NAMES}))}])(?<!\p{{L}})(?:(?:{any_of(MALE_TITLES + FEMALE_TITLES + LOUD_TITLES)})\.? ++{_NAME}(?: ++{_NAME}){{0,2}}"
    rf"|(?:{any_of([*MALE_NAMES, *FEMALE_NAMES, *map(str.upper, MALE_NAMES + FEMALE_NAMES)])}) ++{_NAME})(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# What every entity but a person has: an at sign, five digits and separators in a row, an account's head, or colons.
MARK = rf"@|[0-9][0-9./() -]{{4}}|[A-Z]{{2}}[0-9]{{2}}[A-Z0-9 ]{{11}}|::[0-9A-Fa-f]|(?::{_HEX}){{4}}"
WIDER_AFTER = 8


def kind_of(span: Column) -> Column:
    """The kind of a span that `ANY` matched."""
    return F.coalesce(
        *[F.when(span.rlike(f"^(?:{PATTERNS[k]})$"), k) for k in ("email", "ip", "ip6", "phone", "ssn", "card", "iban")],
        F.when(span.rlike(r"^\d+$"), "phone"),
        F.lit("person"),
    )


def referent(form: Column) -> Column:
    """Letters and digits of a form in lower case."""
    return F.lower(F.regexp_replace(form, r"[^\p{L}\p{N}]", ""))


def script_of(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def name_parts(span: Column) -> Column:
    """The words of a person as (part, kind, form): titles stay, given names have a gender.

    Between blanks that follow each other lies an empty word, which stays, too."""
    words = F.split(span, " ")
    listed = lambda w, names: w.isin(names) | F.initcap(w).isin(names)
    title = lambda w, names: listed(F.regexp_replace(w, r"\.$", ""), names)
    titled = title(words[0], MALE_TITLES + FEMALE_TITLES)
    gender = (
        F.when(title(words[0], MALE_TITLES) | listed(words[0], MALE_NAMES), "male")
        .when(title(words[0], FEMALE_TITLES) | listed(words[0], FEMALE_NAMES), "female")
        .otherwise("surname")
    )
    return F.transform(
        words,
        lambda w, i: F.struct(
            i.alias("part"),
            F.when((titled & (i == 0)) | (w == ""), "title").when(i < F.size(words) - 1, gender).otherwise("surname").alias("kind"),
            w.alias("form"),
        ),
    )


def with_later_mentions(spans: Column) -> Column:
    """The pattern of a text's entities: `ANY`, and the surnames of the persons among `spans` by themselves."""
    persons = F.filter(spans, lambda s: ~s.rlike(r"[@:\p{N}]"))
    surnames = F.transform(persons, lambda s: F.element_at(F.split(s, " "), -1))
    both = F.array_distinct(F.concat(surnames, F.transform(surnames, F.upper)))
    alone = F.concat(F.lit(ANY + r"|(?<!\p{L})(?:"), F.array_join(both, "|"), F.lit(r")(?!\p{L})"))
    return F.when(F.size(persons) > 0, alone).otherwise(F.lit(ANY))


def number_at(digest: Column, at: Column, n: Column | int) -> Column:
    """A number below n from the hex digits of a digest at a place; places wrap around."""
    four = F.conv(F.substr(digest, (at * 3) % 60 + 1, F.lit(4)), 16, 10).cast("int")
    return four % n


def _letter(base: str, n: Column) -> Column:
    return F.substr(F.lit(base), n + 1, F.lit(1))


def same_shape(text: Column, digest: Column) -> Column:
    """Every letter and digit replaced by one of its script."""

    def one(c: Column, i: Column) -> Column:
        pick = lambda letters: _letter(letters, number_at(digest, i, len(letters)))
        return (
            F.when(c.rlike(r"\p{N}"), pick("0123456789"))
            .when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчшэюя"))
            .when(c.rlike(r"\p{IsGreek}"), pick("αβγδεζηθικλμνξοπρστυφχψω"))
            .otherwise(pick("abcdefghijklmnopqrstuvwxyz"))
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def check_sum(digits: Column) -> Column:
    """The sum of the card check over all digits; valid numbers give a multiple of ten."""
    return F.aggregate(
        F.transform(
            F.reverse(F.split(digits, "")),
            lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + (d.cast("int") / 5).cast("int")),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )


def _one_of(values: list[str], digest: Column):
    """A function from a place to the value that the digest picks there."""
    many = F.array(*map(F.lit, values))
    return lambda i: F.element_at(many, number_at(digest, i, len(values)) + 1)


def invented_name(kind: Column, script: Column, digest: Column, attempt: Column) -> Column:
    """Syllables and an ending; more syllables after some attempts."""
    branches = []
    for group, endings in ENDINGS.items():
        for name, syllables in SYLLABLES.items():
            places = F.sequence(F.lit(0), F.lit(1) + (attempt / 3).cast("int"))
            parts = F.transform(places, _one_of(syllables, digest))
            named = F.concat(F.array_join(parts, ""), _one_of(endings[name], digest)(F.lit(17)))
            branches.append(F.when((kind == group) & (script == name), named))
    return F.coalesce(*branches)


def draw(key: str) -> Column:
    """The surrogate of a referent (kind, refers, tail) at an attempt, as letters and digits."""
    kind, refers, attempt = F.col("kind"), F.col("refers"), F.col("attempt")
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, refers, attempt.cast("string")), 256)
    extra = F.when(attempt >= WIDER_AFTER, same_shape(F.lit("00000000"), F.reverse(digest))).otherwise("")
    shaped = same_shape(refers, digest)
    body = F.length(refers) - F.col("tail")
    email = F.concat(F.substr(shaped, F.lit(1), body), extra, F.substr(refers, body + 1, F.col("tail")))
    head = F.substr(shaped, F.lit(1), F.length(shaped) - 1)
    due = (10 - check_sum(F.concat(head, F.lit("0"))) % 10) % 10
    card = F.when(check_sum(refers) % 10 == 0, F.concat(head, due.cast("string"))).otherwise(shaped)
    iban = F.concat(F.substr(refers, F.lit(1), F.lit(2)), F.substr(shaped, F.lit(3)))
    octets = F.transform(
        F.split(refers, r"\."),
        lambda o, i: F.when((attempt >= WIDER_AFTER) | (F.length(o) == 3), 100 + number_at(digest, i, 124))
        .when(F.length(o) == 2, 10 + number_at(digest, i, 90))
        .otherwise(1 + number_at(digest, i, 9))
        .cast("string"),
    )
    groups = F.when(attempt >= WIDER_AFTER, F.regexp_replace(refers, "[0-9a-f]+", "0000")).otherwise(refers)
    hexes = F.transform(F.split(groups, ""), lambda c, i: F.when(c == ":", c).otherwise(_letter("0123456789abcdef", number_at(digest, i, 16))))
    zeros = F.length(F.regexp_extract(refers, "^0*", 0))
    phone = F.concat(F.substr(refers, F.lit(1), zeros), F.substr(shaped, zeros + 1), extra)
    return (
        F.when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "ip6", F.array_join(hexes, ""))
        .when(kind == "phone", phone)
        .when(kind == "email", email)
        .when(kind == "card", F.when(refers.rlike(r"^\d+$"), F.concat(card, extra)).otherwise(F.concat(shaped, extra)))
        .when(kind == "iban", F.concat(iban, extra))
        .when(kind.isin(*ENDINGS), invented_name(kind, script_of(refers), digest, attempt))
        .otherwise(F.concat(shaped, extra))
    )


def in_form(form: Column, surrogate: Column, kind: Column) -> Column:
    """A surrogate with the separators and the case of a form; letters and digits beyond it follow."""
    plain = lambda text: F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    tail = F.when(kind == "email", F.length(F.regexp_extract(form, r"(\.\p{L}+)$", 1))).otherwise(0)
    own = plain(form) - F.greatest(tail - 1, F.lit(0))
    more = F.length(surrogate) - plain(form)

    def one(c: Column, i: Column) -> Column:
        at = plain(F.substr(form, F.lit(1), i + 1))
        new = F.substr(surrogate, F.when(at > own, at + more).otherwise(at), F.lit(1))
        wide = F.when((at == own) & (more > 0), F.substr(surrogate, at + 1, more)).otherwise("")
        cased = F.when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)
        return F.when(c.rlike(r"[\p{L}\p{N}]"), F.concat(cased, wide)).otherwise(c)

    kept = F.array_join(F.transform(F.split(form, ""), one), "")
    upper = ~form.rlike(r"\p{Ll}")
    named = F.when(upper, F.upper(surrogate)).otherwise(F.initcap(surrogate))
    six = F.when(form.rlike("[A-F]"), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind == "ip", surrogate).when(kind == "ip6", six).when(kind.isin(*ENDINGS), named).otherwise(kept)


def assign(referents: DataFrame, key: str) -> DataFrame:
    """(kind, refers, surrogate), all distinct per kind and none a referent itself.

    Of referents that draw the same surrogate the one that sorts first keeps it; the others draw again.
    """
    known = stage(referents.select("kind", "refers", "tail").distinct(), "referents", codec="zstd")
    taken = known.select("kind", F.col("refers").alias("surrogate"))
    pending, done, attempt = known, None, 0
    while True:
        drawn = pending.withColumn("attempt", F.lit(attempt)).withColumn("surrogate", draw(key))
        drawn = stage(drawn.drop("attempt"), "drawn", codec="zstd")
        free = drawn.join(taken, ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min("refers").alias("refers"))
        won = stage(won, "assigned", codec="zstd")
        done = won if done is None else done.unionByName(won)
        pending = stage(drawn.join(won, ["kind", "refers"], "left_anti").drop("surrogate"), "pending", codec="zstd")
        if not pending.limit(1).count():
            return done
        taken = taken.unionByName(won.select("kind", "surrogate"))
        attempt += 1


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """One row per row of `docs`: doc_id, n_entities, text.

    A null text stays null and an empty one empty, with 0 entities; a text without personal data is
    returned as it is. Rows that repeat an id are replaced each. Other columns are ignored; an empty
    table gives an empty result.
    """
    whole = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Cheap necessary conditions first: most texts have nothing that the patterns need to look at.
    hit = F.coalesce(F.col("text").rlike(MARK) | F.col("text").rlike(PATTERNS["person"]), F.lit(False))
    found = (
        whole.where(hit)
        .select("doc_id", "text", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("first"))
        .select("doc_id", "text", with_later_mentions(F.col("first")).alias("pattern"))
        .select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.split("text", F.col("pattern"), -1).alias("gaps"),
            F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("spans"),
        )
    )
    found = stage(found, "entities", codec="zstd")
    spans = found.select("row", F.posexplode("spans").alias("at", "span")).withColumn("kind", kind_of(F.col("span")))
    alone = F.array(F.struct(F.lit(0).alias("part"), F.col("kind").alias("kind"), F.col("span").alias("form")))
    parts = spans.select(
        "row", "at", F.explode(F.when(F.col("kind") == "person", name_parts(F.col("span"))).otherwise(alone)).alias("p")
    ).select("row", "at", "p.*")
    ending = F.length(F.regexp_extract("form", r"\.(\p{L}+)$", 1))
    parts = parts.withColumn("refers", F.when(F.col("kind") == "ip", F.col("form")).when(F.col("kind") == "ip6", F.lower("form")).otherwise(referent(F.col("form"))))
    parts = parts.withColumn("tail", F.when(F.col("kind") == "email", ending).otherwise(0))
    parts = stage(parts, "mentions", codec="zstd")
    given = assign(parts.where("kind != 'title'"), key)
    said = parts.join(given, ["kind", "refers"], "left").select(
        "row", "at", "part",
        F.when(F.col("kind") == "title", F.col("form"))
        .otherwise(in_form(F.col("form"), F.col("surrogate"), F.col("kind")))
        .alias("said"),
    )
    ordered = said.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "part", "said"))).alias("said"))
    text = F.aggregate(
        "said",
        F.element_at("gaps", 1),
        lambda t, s: F.concat(t, F.when(s["part"] > 0, F.lit(" ")).otherwise(""), s["said"],
                              F.when(s["last"], F.element_at(F.col("gaps"), s["at"] + 2)).otherwise("")),
    )
    marked = F.transform(
        "said",
        lambda s, i: s.withField("last", F.coalesce(F.get(F.col("said"), i + 1)["at"] != s["at"], F.lit(True))),
    )
    rebuilt = (
        found.where(F.size("spans") > 0).select("row", "doc_id", "gaps", F.size("spans").cast("long").alias("n_entities"))
        .join(ordered, "row")
        .withColumn("said", marked)
        .select("doc_id", "n_entities", text.alias("text"))
    )
    untouched = whole.where(~hit).select("doc_id", F.lit(0).cast("long").alias("n_entities"), "text")
    clean = found.where(F.size("spans") == 0).select(
        "doc_id", F.lit(0).cast("long").alias("n_entities"), F.element_at("gaps", 1).alias("text")
    )
    return untouched.unionByName(clean).unionByName(rebuilt)
