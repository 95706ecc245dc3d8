"""PII surrogates (operator 9).  DataFrame functions only.

Detected entities get keyed replacements of their own type and form: cards keep
their grouping, first digit and a valid check digit, phone and social security
numbers their grouping and country code, addresses their dotted or user@host
form, names their script, case and the gender of the title before them.  Equal
entities (whatever their grouping or case) get equal surrogates in all texts;
the words of a name are replaced one by one, so "Mrs Anna Lopez" and "Mrs Lopez"
still share their surname.  A name is all initials, particles and capitalised words
behind its title; the last is the surname, and an initial becomes a word with its dot.

Distinctness is checked, not hoped for: a surrogate that two entities would
share stays with the first of them, one that equals a real entity is refused,
and the refused ones try again with the next attempt number, until none is
left.  Only distinct entities take part, and the texts that hold some shuffle
once to meet their replacements; other texts pass straight through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.common import spare_name, stored

KEY = "surrogate-key"  # production callers pass their own secret
MAX_ATTEMPTS = 24

MALE_TITLES = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")
NEUTRAL_TITLES = ("Dr", "Prof", "Mx")
_TITLES = "|".join(sorted(MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES, key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"

EMAIL = r"(?<![\p{L}\p{N}_.+%-])[\p{L}\p{N}_.+%-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
MARK = "\ufdd0\ufdd1\ufdd0"  # noncharacters: no card starts behind it; only inside this module
OWN, SAFE = "\ufdd0", "\ufdd0\ufdd2"  # the caller's own U+FDD0 meanwhile
CARD = rf"(?<![\d-])(?<!\d\.)(?<!{MARK})\d(?:[ -]?\d){{12,18}}(?!\d)"
CARD_FORM = r"\d(?:[ -]?\d){12,18}"
USUAL_CARD = r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5}"
PHONE = (r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
         r"|(?<![\d+])\+\d{8,15}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\d)|(?<![\d-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])")
PARTICLES = r"(?:de|del|della|der|den|di|da|do|dos|du|la|las|le|los|van|von|vom|zu|zum|y|e|el|al|bin|ibn|ter|ten) "
_WORD = r"(?:(?:\p{Lu}\.[ -]?)*\p{Lu}[\p{L}'-]+|\p{Lu}(?= \p{Lu})|(?:\p{Lu}\.-?)+)"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLES})\.? (?:{PARTICLES})*+{_WORD}(?: (?:{PARTICLES})*+{_WORD})*"
ENTITY = "|".join([EMAIL, IP, SSN, CARD, PHONE, NAME])
RUN_END = r"(?:[ -]?\d)*+"
REGION = "|".join([EMAIL, IP, SSN, CARD + RUN_END, PHONE, NAME])  # a card's match with the rest of its run of digits
WALK = 512  # tokens of a run that are walked with one list
# What every entity has: an @, a digit, or a word that may be a title before a capital.
HINT = rf"[@0-9]|[{''.join(sorted({t[0] for t in MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES}))}]\p{{L}}{{1,8}}\.? (?:{PARTICLES})*\p{{Lu}}"

KINDS = ("email", "ip", "ssn", "card", "phone", "name")

LATIN_SYLLABLES = "ba be bi da de di fa ga ka la le li ma me mi na ne no ra re ri ro sa se ta te ti to va ve vi wa".split()
CYRILLIC_SYLLABLES = "ба бе ва ве га да де жа за ка ла ле ма ме на не но па ра ре ро са се та те ти то фа ха ша ди ли".split()
ENDINGS = {"latin": {"male": ["ron", "tan", "mus", "rik"], "female": ["na", "lia", "nelle", "rine"],
                     "given": ["ry", "len", "kim", "rin"], "surname": ["son", "mann", "ley", "ford"]},
           "cyrillic": {"male": ["рон", "тан", "мир", "рик"], "female": ["на", "лия", "нелла", "рина"],
                        "given": ["рин", "лен", "ким", "ша"], "surname": ["ков", "нин", "енко", "ский"]}}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _draw(hashed: Column, i: Column, most: int) -> Column:
    """The i-th draw below ``most`` from a SHA-256 in hexadecimal."""
    return (F.conv(F.substr(hashed, ((i % 15) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")
            + (i / 15).cast("int") * 7) % most


def is_card(entity: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    d = F.transform(F.split(F.reverse(_digits(entity)), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    summed = F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)),
                         F.lit(0), lambda a, x: a + x)
    return summed % 10 == 0


def kind_of(entity: Column) -> Column:
    """The kind of a match of ENTITY; null for digits that are no card number."""
    whole = lambda p: entity.rlike(f"^(?:{p})$")
    return (F.when(entity.contains("@"), "email").when(whole(IP), "ip").when(whole(SSN), "ssn")
            .when(whole(NAME), "name").when(whole(CARD), F.when(is_card(entity), F.lit("card"))).when(whole(PHONE), "phone"))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: as the only element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _usual(e: Column) -> Column:
    return e.rlike(rf"^(?:{USUAL_CARD})$")


def _n_tokens(e: Column) -> Column:
    return F.size(F.split(e, " "))


def _outcomes(token: Column, ahead: Column) -> Column:
    """What a scan that arrives at ``token`` does, ``fresh`` and ``late`` (behind a failed start).

    ``ahead`` is the text from the token on.  ``n`` tokens are used up, ``mark`` is the place of a MARK
    in the last of them (-1: none), ``open`` tells whether a failed start is open behind them."""
    phone = token.rlike(r"^\d{3}-\d{3}-\d{4}$")

    def used(n: Column, mark: Column, open_: Column) -> Column:
        return F.struct(n.cast("int").alias("n"), mark.cast("int").alias("mark"), open_.alias("open"))

    def judged(c: Column) -> Column:
        ends = [F.regexp_extract(c, rf"^(\d(?:[ -]?\d){{{n - 1}}})[ -]", 1) for n in range(18, 12, -1)]
        return F.struct(c.alias("card"), is_card(c).alias("ok"), _usual(c).alias("usual"),
                        F.filter(F.array(*ends), lambda p: (p != "") & is_card(p)).alias("shorter"))

    def outcome(own: Column, late: bool) -> Column:
        strict = F.lit(late) | phone  # only cards of a usual grouping
        short = F.get(F.when(strict, F.filter(own["shorter"], _usual)).otherwise(own["shorter"]), F.lit(0))
        cut = _bound(short, lambda e: used(_n_tokens(e), F.length(F.element_at(F.split(e, " "), -1)), F.lit(False)))
        return (F.when(own["ok"] & (own["usual"] | ~strict), used(_n_tokens(own["card"]), F.lit(-1), F.lit(False)))
                .when(short.isNotNull(), cut).otherwise(used(F.lit(1), F.lit(0), ~phone)))

    def both(own: Column) -> Column:
        return F.struct(outcome(own, False).alias("fresh"), outcome(own, True).alias("late"))

    def passed(late: bool) -> Column:
        return used(F.lit(1), F.lit(-1), F.lit(late) & ~phone & ~token.rlike(rf"^(?:{SSN})$"))

    card = F.when(token.rlike(rf"^(?:{SSN})$"), "").otherwise(F.regexp_extract(ahead, rf"^{CARD_FORM}(?!\d)", 0))
    return _bound(card, lambda c: F.when(c == "", F.struct(passed(False).alias("fresh"), passed(True).alias("late")))
                  .otherwise(_bound(judged(c), both)))


def _settled_run(run: Column, late: Column) -> Column:
    """A run of digit groups with its MARKs: every blank-parted token is judged once, by the 40 characters
    ahead of it, and one walk from left to right (in pieces, whose lists stay short) takes what applies."""

    def walk(state: Column, own: Column) -> Column:
        use = F.when(state["late"], own["late"]).otherwise(own["fresh"])
        skips = state["skip"] > 0
        skip = F.when(skips, state["skip"] - 1).otherwise(use["n"] - 1)
        mark = F.when(skips, state["mark"]).otherwise(use["mark"])
        return F.struct(skip.alias("skip"), mark.alias("mark"), F.when(skips, state["late"]).otherwise(use["open"]).alias("late"),
                        F.concat(state["out"], F.array(F.when(skip == 0, mark).otherwise(F.lit(-1)))).alias("out"))

    def begin(skip: Column, mark: Column, late: Column) -> Column:
        return F.struct(skip.alias("skip"), mark.alias("mark"), late.alias("late"), F.array().cast("array<int>").alias("out"))

    def piece(state: Column, own: Column) -> Column:
        return _bound(F.aggregate(own, begin(state["skip"], state["mark"], state["late"]), walk), lambda x: F.struct(
            x["skip"].alias("skip"), x["mark"].alias("mark"), x["late"].alias("late"),
            F.concat(state["out"], x["out"]).alias("out")))

    def marks(tokens: Column) -> Column:
        def at(i: Column) -> Column:  # no slices: each would copy the whole list
            return _outcomes(F.get(tokens, i), F.substring(F.concat_ws(" ", *[F.get(tokens, i + j) for j in range(19)]), 1, 40))

        last = F.size(tokens) - 1
        pieces = F.transform(F.sequence(F.lit(0), (last / WALK).cast("int")), lambda k: F.transform(
            F.sequence(k * WALK, F.least(k * WALK + WALK - 1, last)), at))
        return F.aggregate(pieces, begin(F.lit(0), F.lit(-1), late), piece)["out"]

    def put(tokens: Column) -> Column:
        return _bound(marks(tokens), lambda at: F.array_join(F.transform(tokens, lambda t, i: F.when(
            F.get(at, i) < 0, t).otherwise(F.concat(F.substr(t, F.lit(1), F.get(at, i)), F.lit(MARK),
                                                    F.substr(t, F.get(at, i) + 1)))), " "))

    return _bound(F.split(run, " "), put)


def settled_cards(text: Column) -> Column:
    """``text`` with a MARK wherever a match of CARD is no card as a whole.

    A match is no card if it fails the Luhn check, or begins as a phone or social
    security number or behind a failed start and has no usual card grouping.  The
    longest shorter prefix at a group boundary that is a card gets a MARK behind it,
    so it matches alone and the digits after it are scanned afresh; without one
    the MARK goes in front, so other kinds and later groups are tried.  A run of
    digit groups is settled from left to right at once (no card starts behind a decimal point); a further round over the
    text runs while marks were set, as entities may then match elsewhere.  The work
    grows with the text's length, also in texts that are one run."""

    def settled(found: Column, gaps: Column) -> Column:
        def one(gap: Column, i: Column) -> Column:
            return F.concat(gap, F.coalesce(_bound(F.get(found, i), lambda e: F.when(e.rlike(
                rf"^{CARD_FORM}{RUN_END}$"), _settled_run(e, gap.rlike(rf"{MARK}\d[\d -]*$"))).otherwise(e)), F.lit("")))

        return F.array_join(F.transform(gaps, one), "")

    def step(state: Column) -> Column:
        cut = F.struct(F.regexp_extract_all(state["text"], F.lit(REGION), 0).alias("found"),
                       F.split(state["text"], REGION, -1).alias("gaps"))
        new = _bound(cut, lambda x: settled(x["found"], x["gaps"]))
        return _bound(new, lambda x: F.struct(x.alias("text"), (x != state["text"]).alias("open")))

    def rounds(state: Column, level: int) -> Column:
        # 32 rounds of 32 rounds ...: more than a text has characters (a round sets at least one mark), and few
        # steps once nothing is open, as every step of an aggregate copies its state
        many = F.aggregate(F.sequence(F.lit(1), F.lit(32)), state, lambda x, _: rounds(x, level - 1)) if level else step(state)
        return F.when(state["open"], many).otherwise(state)

    begun = F.struct(text.alias("text"), F.lit(True).alias("open"))
    done = F.aggregate(F.array(F.lit(0)), begun, lambda x, _: rounds(x, 6))["text"]
    return F.when(text.rlike(CARD), done).otherwise(text)


def _numbers(hashed: Column, norm: Column, kept: int) -> Column:
    """Digits for the digits of ``norm``; the first ``kept`` stay."""
    n = F.length(norm)
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(
        i < kept, F.substr(norm, (i + 1).cast("int"), F.lit(1))).otherwise(_draw(hashed, i, 10).cast("string"))), "")


def surrogate(kind: Column, norm: Column, attempt: int, key: str) -> Column:
    """The core of a replacement: digits, an address or a word, in lower case."""
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, F.lit(str(attempt))), 256)
    body = _numbers(h, F.substring(norm, 1, 64), 1)
    body = F.substr(body, F.lit(1), F.length(norm) - 1)
    check = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.struct(
        is_card(F.concat(body, d.cast("string"))).alias("ok"), F.concat(body, d.cast("string")).alias("number")))
    card = F.get(F.filter(check, lambda x: x["ok"]), F.lit(0))["number"]
    first = F.lit("10") if attempt < 4 else (_draw(h, F.lit(0), 223) + 1).cast("string")
    ip = F.concat_ws(".", first, *[_draw(h, F.lit(i), 256).cast("string") for i in (1, 2, 3)])
    user = F.split(norm, "@")[0]
    chars = F.filter(F.split(user, ""), lambda c: c != "")
    shaped = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"\p{N}"), _draw(h, i, 10).cast("string"))
                                      .when(c.rlike(r"\p{IsCyrillic}"), F.get(
                                          F.array(*map(F.lit, "абвгдежзиклмнопрстуфхцчшэюя")), _draw(h, i, 27)))
                                      .when(c.rlike(r"\p{L}"), F.char(97 + _draw(h, i, 26))).otherwise(c)), "")
    host = F.array_join(F.transform(F.sequence(F.lit(3), F.lit(8)), lambda i: F.char(97 + _draw(h, i, 26))), "")
    email = F.concat(shaped, F.lit("@"), host, F.lit(".example"))

    def word(script: str, syllables: list[str]) -> Column:
        part = F.array(*map(F.lit, syllables))
        stem = F.concat(*[F.get(part, _draw(h, F.lit(i), len(syllables))) for i in range(2 + attempt // 2)])
        ends = ENDINGS[script]
        end = F.when(F.lit(False), F.lit(""))
        for gender, own in ends.items():
            end = end.when(kind == gender, F.get(F.array(*map(F.lit, own)), _draw(h, F.lit(14), len(own))))
        return F.concat(stem, end)

    name = F.when(norm.rlike(r"^\p{IsCyrillic}"), word("cyrillic", CYRILLIC_SYLLABLES)).otherwise(
        word("latin", LATIN_SYLLABLES))
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card)
            .when(kind == "ssn", _numbers(h, norm, 0)).when(kind == "phone", _numbers(h, norm, 1)).otherwise(name))


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm) distinct -> (kind, norm, surrogate), one to one within a kind and
    never a real entity of that kind."""
    pending, assigned = stored(entities, "op9-entities"), None
    real = pending
    for attempt in range(MAX_ATTEMPTS):
        tried = pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("norm"), attempt, key))
        rank = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("norm"))
        taken = real.select("kind", F.col("norm").alias("surrogate"))
        if assigned is not None:
            taken = taken.unionByName(assigned.select("kind", "surrogate"))
        won = stored(tried.join(taken, ["kind", "surrogate"], "left_anti").withColumn("rank", rank).where("rank = 1")
                     .select("kind", "norm", "surrogate"), "op9-assigned")
        assigned = won if assigned is None else assigned.unionByName(won)
        pending = stored(pending.join(won, ["kind", "norm"], "left_anti"), "op9-pending")
        if pending.isEmpty():
            return assigned
    raise ValueError(f"no distinct surrogates after {MAX_ATTEMPTS} attempts")


def _dressed(core: Column, original: Column) -> Column:
    """A name's core in the case of the original word."""
    return (F.when(original.endswith("."), F.concat(F.initcap(core), F.lit(".")))
            .when((F.upper(original) == original) & (F.length(original) > 1), F.upper(core))
            .when(F.lower(original) == original, core).otherwise(F.initcap(core)))


def _regrouped(core: Column, entity: Column) -> Column:
    """The digits of ``core`` in the grouping of ``entity``."""
    chars = F.filter(F.split(entity, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"\d"), F.substr(
        core, F.length(_digits(F.substr(entity, F.lit(1), (i + 1).cast("int")))), F.lit(1))).otherwise(c)), "")


def replace_entities(docs: DataFrame, key: str = "doc_id", text: str = "text", secret: str = KEY,
                     out: str = "entities") -> DataFrame:
    """``docs`` with the entities of ``text`` replaced and a map column ``out``: entities by kind.

    Null texts stay null and empty ones empty, with empty maps; null keys are
    keys; rows equal in key and text get equal results.  Other columns pass
    through; ``out`` must not be among them.  An empty table gives an empty table."""
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {out}")
    body = F.col(text)
    safe = F.when(body.contains(OWN), F.replace(body, F.lit(OWN), F.lit(SAFE))).otherwise(body)
    holds = F.coalesce(body.rlike(HINT) & body.rlike(ENTITY), F.lit(False))  # the cheap pattern first
    key_, hash_, all_, mark, settled = (spare_name(docs, n) for n in (
        "own_key", "own_hash", "own_entities", "text_hash", "settled_text"))
    # Texts with entities are settled once and stored; both uses below read them back.
    some = stored(docs.where(holds).withColumns({mark: F.xxhash64(body), settled: settled_cards(safe)}), "op9-settled")
    found = some.select(F.col(key).alias("key"), F.col(mark).alias("hash"),
                        F.regexp_extract_all(settled, F.lit(ENTITY), 0).alias("all")).dropDuplicates(["key", "hash"])
    rows = found.select("key", "hash", F.posexplode_outer("all").alias("pos", "entity")).withColumn("type", kind_of(F.col("entity")))
    words = F.split(F.col("entity"), " ")
    title = F.regexp_replace(words[0], r"\.$", "")
    gender = F.when(title.isin(*MALE_TITLES), "male").when(title.isin(*FEMALE_TITLES), "female").otherwise("given")
    is_name = F.col("type") == "name"
    norm = (F.when(F.col("type").isin("card", "phone", "ssn"), _digits(F.col("entity"))).otherwise(F.lower("entity")))
    # the words of a name behind its title: the last is the surname, all others have the title's gender
    parts = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda w, i: F.struct(
        F.when(i == F.size(words) - 2, F.lit("surname")).otherwise(gender).alias("kind"),
        F.rtrim(F.lower(w), F.lit(".")).alias("norm"), w.alias("word")))
    whole = F.array(F.struct(F.col("type").alias("kind"), norm.alias("norm"), F.col("entity").alias("word")))
    rows = stored(rows.select("key", "hash", "pos", "entity", "type", words[0].alias("title"),
                              F.posexplode(F.when(is_name, parts).otherwise(whole)).alias("part", "own"))
                  .select("key", "hash", "pos", "entity", "type", "title", "part", "own.*"), "op9-found")
    entities = rows.where("kind is not null").select("kind", "norm").distinct()
    names = stored(assign(entities, secret), "op9-surrogates").select(
        F.col("kind").alias("k"), F.col("norm").alias("n"), F.col("surrogate").alias("core"))
    joined = rows.join(names, (F.col("kind") == F.col("k")) & (F.col("norm") == F.col("n")), "left")
    lead = F.when(F.col("part") == 0, F.concat("title", F.lit(" "))).otherwise(" ")
    new = (F.when(F.col("type").isNull(), F.col("entity"))
           .when(F.col("type") == "name", F.concat(lead, _dressed(F.col("core"), F.col("word"))))
           .when(F.col("type").isin("card", "phone", "ssn"), _regrouped(F.col("core"), F.col("entity")))
           .otherwise(F.col("core")))
    one = joined.select("key", "hash", F.struct("pos", "part", new.alias("new"), "type").alias("e"))
    per_text = one.groupBy(F.col("key").alias(key_), F.col("hash").alias(hash_)).agg(
        F.array_sort(F.collect_list("e")).alias(all_))

    def held(kind: str) -> Column:
        return F.size(F.filter(all_, lambda x: (x["type"] == kind) & (x["part"] == 0)))

    counts = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*map(held, KINDS)))
    pieces = F.filter(all_, lambda x: x["pos"].isNotNull())
    put = _bound(F.split(settled, ENTITY, -1), lambda between: F.concat(F.array_join(F.transform(
        pieces, lambda x: F.concat(F.when(x["part"] == 0, F.get(between, x["pos"])).otherwise(""), x["new"])), ""),
        F.element_at(between, -1)))
    put = F.replace(F.replace(put, F.lit(MARK), F.lit("")), F.lit(SAFE), F.lit(OWN))
    met = some.join(per_text, F.col(key).eqNullSafe(F.col(key_)) & (F.col(mark) == F.col(hash_)))
    done = met.select(*[put.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], counts.alias(out))
    empty = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*[F.lit(0) for _ in KINDS]))
    rest = docs.where(~holds).withColumn(out, empty)
    return done.unionByName(rest)


def pii_report(docs: DataFrame) -> DataFrame:
    """op9: one row per document with its text after replacement and its entities by kind."""
    done = replace_entities(docs.select("doc_id", "text"))
    return done.select("doc_id", "text", *[F.col("entities")[k].cast("bigint").alias(f"n_{k}") for k in KINDS])
