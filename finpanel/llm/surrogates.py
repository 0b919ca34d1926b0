"""Personal data replaced by surrogates: keyed, of the same type, gender, script and format, distinct where the originals are.

Mentions are found by one pattern; the distinct values behind them (addresses, numbers, keys, parts of names) make a table that
is reduced before any join, gets its surrogates there, and is checked: no two values of a kind share a surrogate and none is a value
of the data. Values that fail are tried again. Every mention of a value gets the same surrogate, in all documents.

Names are found behind titles and phrases; the words of a name so found are replaced wherever else they stand in that document, in capitals too, unless
the document has the same word in lower case or it is the name of a month or day. A mailbox that is made of names gets their surrogates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finpanel.session import materialize

#: Titles and phrases before names, by the gender they show.
MALE = ["Mr", "Sir", "Herr", "Señor", "Sr", "Monsieur", "Don", "Господин", "господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Sra", "Madame", "Mme", "Doña", "Госпожа", "госпожа"]
EITHER = ["Dr", "Prof", "My name is", "my name is", "Je m'appelle", "je m'appelle", "Me llamo", "me llamo", "Ich heiße", "ich heiße", "Меня зовут", "меня зовут"]
#: Common given names, for titles that show no gender.
MALE_NAMES = ["James", "John", "Robert", "Michael", "David", "William", "Thomas", "Peter", "Paul", "Hans", "Jürgen", "Pierre", "Jean", "Luc", "José", "Juan", "Carlos", "Luis", "Иван", "Пётр", "Сергей", "Дмитрий"]
FEMALE_NAMES = ["Mary", "Jane", "Anna", "Linda", "Susan", "Sarah", "Emily", "Julia", "Greta", "Ursula", "Marie", "Claire", "Sophie", "María", "Carmen", "Lucía", "Elena", "Анна", "Мария", "Ольга", "Наталья"]
#: Syllables and endings that surrogate names are made of.
LATIN = ["ba", "be", "bri", "ca", "co", "da", "de", "do", "fa", "fe", "ga", "go", "ha", "hel", "ja", "jo", "ka", "ke", "la", "le", "lo", "ma", "me", "mi", "na", "ne", "no", "pa", "pe", "ra", "re", "ro", "sa", "so", "ta", "to", "va", "ve", "wa", "ze"]
CYRILLIC = ["ба", "бе", "ва", "ве", "га", "го", "да", "де", "до", "жа", "за", "зо", "ка", "ке", "ко", "ла", "ле", "ло", "ма", "ме", "ми", "на", "не", "но", "па", "пе", "ра", "ре", "ро", "са", "со", "та", "те", "то", "фа", "фе"]
GREEK = ["βα", "βε", "γα", "γε", "δα", "δο", "ζα", "θε", "κα", "κο", "λα", "λε", "λο", "μα", "με", "μι", "να", "νε", "νο", "πα", "πε", "ρα", "ρε", "ρο", "σα", "σο", "τα", "τε", "φα", "χα"]
ENDINGS = {
    ("given_m", "latin"): ["n", "rd", "s", "mar", "vin", "ton"], ("given_f", "latin"): ["lina", "ria", "nna", "ssa", "lia", "tta"], ("given_x", "latin"): ["ris", "lex", "kim", "ren"],
    ("surname", "latin"): ["son", "mann", "rez", "ner", "well", "ber", "ton", "dal"],
    ("given_m", "cyrillic"): ["н", "лав", "мир", "тин"], ("given_f", "cyrillic"): ["на", "рия", "лина", "са"], ("given_x", "cyrillic"): ["ша", "ня"], ("surname", "cyrillic"): ["ко", "нюк", "дзе", "шин"],
    ("given_m", "greek"): ["ος", "ης", "ων"], ("given_f", "greek"): ["ία", "ίνα", "ώ"], ("given_x", "greek"): ["ις", "η"], ("surname", "greek"): ["όπουλος", "ίδης", "άκης", "άτος"],
}
STEMS = {"latin": LATIN, "cyrillic": CYRILLIC, "greek": GREEK}
#: Letters of scripts whose letters are drawn anew one by one.
ALPHABETS = {"Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω", "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת", "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"}
#: Names that are also months, days or seasons; alone they are no mention.
AMBIGUOUS = ["April", "May", "June", "August", "Avril", "Juin", "Mai", "Juni", "Abril", "Mayo", "Junio", "Sunday", "Monday", "Friday", "Domingo", "Summer", "Winter", "Sommer"]

#: Behind ``=`` and in quotes any value is a secret; behind a bare colon only one with a digit, as prose goes on there ("password: required").
DIGIT_VALUE, ANY_VALUE = r"""(?=[^\s"',;]*\d)[^\s"',;]{6,}""", r"""(?=[^\s"',;]*[\p{L}\d])[^\s"',;]{6,}"""
SECRET = (
    r"""(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}"""
    rf"""(?:=\s{{0,3}}["']?{ANY_VALUE}|:\s{{0,3}}(?:["']?{DIGIT_VALUE}|"{ANY_VALUE}(?=")|'{ANY_VALUE}(?=')))"""
)
#: Small words inside names, which stay as they are.
PARTICLES = "van|von|vom|der|den|de|del|della|di|da|do|dos|das|du|la|las|los|le|el|al|bin|ibn|ben|ter|ten|zu|zum|zur|af|av|y|e"
PREFIX = rf"(?:(?:(?:{PARTICLES})[ -])*+(?:[dl]['’](?=\p{{Lu}}))?+)"
#: One part of a name: inner capitals, apostrophes (O'Neil, D'Angelo), or an initial before another part.
WORD = r"(?:\p{Lu}\.(?= ?\p{Lu}[\p{L}\p{M}.'’])|\p{Lu}['’]\p{L}[\p{L}\p{M}]++|\p{Lu}[\p{L}\p{M}]*+(?:['’]\p{Lu}[\p{L}\p{M}]*+)*+)"
TITLE = rf"(?:(?:{'|'.join(MALE + FEMALE + EITHER)})\.? )++"
NAME = rf"{TITLE}{PREFIX}{WORD}(?:(?:[ -]|(?<=\.)){PREFIX}{WORD})*+"
#: A part of a name that stands alone in the text.
ALONE = rf"(?<![\p{{L}}\p{{N}}])(?:\p{{Lu}}['’]\p{{L}}[\p{{L}}\p{{M}}]++|\p{{Lu}}[\p{{L}}\p{{M}}]++(?:['’]\p{{Lu}}[\p{{L}}\p{{M}}]*+)*+)(?![\p{{L}}\p{{N}}])"
#: A word of the text in lower case.
LOWER_WORD = r"(?<![\p{L}\p{M}])\p{Ll}[\p{Ll}\p{M}]++(?![\p{L}])"
CARD = r"(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}|3[47]\d{2}([ -]?)\d{6}\2\d{5})(?![\d-])"
PATTERN = "(?<![\\p{L}\\p{N}])(?:" + "|".join([
    r"(?<![._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    SECRET,
    r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    r"gh[pousr]_[0-9A-Za-z]{36,}+",
    r"eyJ[0-9A-Za-z_-]{8,}+\.eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+",
    r"(?<!:)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    CARD,
    r"\d{3}-\d{2}-\d{4}(?![\d-])",
    r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    r"(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)",
    r"\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    r"\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    r"0\d{2,4}[ /-]\d{5,8}(?![\d-])",
    NAME,
]) + ")"


def kind_of(mention):
    """What a mention found by the pattern is."""
    return (
        F.when(mention.rlike("^" + SECRET + "$"), "secret").when(mention.contains("@"), "email").when(mention.rlike("^((AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]+|eyJ[0-9A-Za-z_.-]+)$"), "key")
        .when(mention.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]+$"), "iban").when(mention.rlike("^" + CARD + "$"), "card").when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(mention.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip").when(mention.rlike("^[0-9A-Fa-f]+:[0-9A-Fa-f:]+$"), "ip6").when(mention.rlike(r"^\p{L}"), "name").otherwise("phone")
    )


def is_name(mention):
    return mention.rlike("^" + TITLE)


def parts_of(mention):
    """The mention as parts in order: kind (null: kept as it stands) and value."""
    def part(kind, value):
        return F.struct(kind.cast("string").alias("kind"), value.alias("value"))

    plain = F.lit(None)
    head = F.regexp_extract(mention, r"""^([^=:]*[=:]\s{0,3}["']?)""", 1)
    title = F.regexp_extract(mention, rf"^({TITLE})", 1)
    names = F.substr(mention, F.length(title) + 1)
    words, gaps = F.regexp_extract_all(names, F.lit(WORD), F.lit(0)), F.split(names, WORD, -1)
    first = F.get(words, F.lit(0))

    def titled(titles):
        return title.rlike(rf"(?:^| )(?:{'|'.join(titles)})\.? ")

    gender = F.when(titled(MALE), "given_m").when(titled(FEMALE), "given_f").when(first.isin(MALE_NAMES), "given_m").when(first.isin(FEMALE_NAMES), "given_f").otherwise("given_x")
    said = titled([e for e in EITHER if " " in e])

    def named(word, i):
        """The first of several parts, initials and common given names are given names, all others surnames; one part after a title is
        a surname, after a phrase a given name."""
        given = F.when(F.size(words) == 1, said).when(i == F.size(words) - 1, False).otherwise((i == 0) | word.endswith(".") | word.isin(MALE_NAMES + FEMALE_NAMES))
        return F.array(part(plain, F.get(gaps, i)), part(F.when(given, gender).otherwise("surname"), word))

    return (
        F.when(kind_of(mention) == "secret", F.array(part(plain, head), part(F.lit("secret"), F.substr(mention, F.length(head) + 1))))
        .when(kind_of(mention) == "name", F.concat(F.array(part(plain, title)), F.flatten(F.transform(words, named))))
        .when(kind_of(mention) == "email", F.array(
            part(F.lit("mailbox"), F.substring_index(mention, "@", 1)), part(plain, F.lit("@")), part(F.lit("domain"), F.regexp_extract(mention, r"@(.*)\.\p{L}+$", 1)),
            part(plain, F.regexp_extract(mention, r"(\.\p{L}+)$", 1)),
        ))
        .otherwise(F.array(part(kind_of(mention), mention)))
    )


def _pick(items: list[str], digest, *salt):
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(F.xxhash64(digest, *salt), F.lit(len(items))) + 1).cast("int"))


def _char(alphabet: str, digest, i):
    return F.substr(F.lit(alphabet), (F.pmod(F.xxhash64(digest, i), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scrambled(value, digest, keep):
    """``value`` with every digit and letter after the first ``keep`` characters drawn anew, of the same class."""
    hexed, hexed_up = value.rlike("^[0-9a-f:]+$"), value.rlike("^[0-9A-F]+:[0-9A-F:]+$")

    def char(c, i):
        low = F.when(hexed, _char("abcdef", digest, i)).otherwise(_char(LOWER, digest, i))
        high = F.when(hexed_up, _char("ABCDEF", digest, i)).otherwise(_char(UPPER, digest, i))
        foreign = F.when(~c.rlike(r"\p{L}"), c)
        for script, letters in ALPHABETS.items():
            foreign = foreign.when(c.rlike(rf"\p{{Is{script}}}"), _char(letters, digest, i))
        foreign = foreign.otherwise(_char(LOWER, digest, i))
        foreign = F.when(c.rlike(r"\p{Lu}"), F.upper(foreign)).otherwise(foreign)
        drawn = F.when(c.between("0", "9"), _char(DIGITS, digest, i)).when(c.between("a", "z"), low).when(c.between("A", "Z"), high).otherwise(foreign)
        return F.when(i < keep, c).otherwise(drawn)

    return F.array_join(F.transform(F.split(value, ""), char), "")


def _luhn(digits):
    """Sum of the Luhn rule over an array of digits."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def _digits(value):
    return F.transform(F.split(F.regexp_replace(value, r"\D", ""), ""), lambda d: d.cast("int"))


def surrogate(kind, value, attempt, key: str):
    """The surrogate of one value. From the 13th attempt on the format may grow, for formats with hardly a free value left."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string")), 256)
    grown = F.greatest(attempt - 12, F.lit(0))
    longer = F.concat(value, F.repeat(F.lit("0"), grown))
    country = F.length(F.regexp_extract(value, r"^\+?\d{1,3}(?=[ .(-])", 0))
    keep = F.when(kind == "phone", F.when(value.startswith("+"), country).otherwise(0)).when(kind == "card", 1).when(kind.isin("iban", "key"), F.when(value.startswith("eyJ"), 3).when(kind == "key", 4).otherwise(2)).otherwise(0)
    chars = scrambled(longer, digest, keep)
    last = F.pmod(F.lit(10) - F.pmod(_luhn(_digits(F.concat(F.substr(chars, F.lit(1), F.length(chars) - 1), F.lit("0")))), F.lit(10)), F.lit(10))
    card = F.when((F.pmod(_luhn(_digits(value)), F.lit(10)) == 0) & (grown == 0), F.concat(F.substr(chars, F.lit(1), F.length(chars) - 1), last.cast("string"))).otherwise(chars)

    def octet(o, i):
        drawn = F.pmod(F.xxhash64(digest, i), F.lit(10_000)).cast("int")
        wide = (F.length(o) > 2) | (grown > 0)
        return F.when(wide, 100 + drawn % 155).when(F.length(o) == 2, 10 + drawn % 90).otherwise(1 + drawn % 9).cast("string")

    ip = F.array_join(F.transform(F.split(value, r"\."), octet), ".")
    def name(of: str, script: str):
        stems = F.transform(F.sequence(F.lit(1), 2 + F.floor(attempt / 4).cast("int")), lambda i: _pick(STEMS[script], digest, i))
        return F.initcap(F.concat(F.array_join(stems, ""), _pick(ENDINGS[of, script], digest, F.lit("end"))))

    names = F.when(kind == "ip", ip).when(kind == "card", card)
    for of in ("given_m", "given_f", "given_x", "surname"):
        names = names.when((kind == of) & value.rlike(r"\p{IsCyrillic}"), name(of, "cyrillic")).when((kind == of) & value.rlike(r"\p{IsGreek}"), name(of, "greek")).when(kind == of, name(of, "latin"))
    return names.otherwise(chars)


def assign(values: DataFrame, key: str, rounds: int = 60) -> DataFrame:
    """kind, value, surrogate for distinct (kind, value) rows, with surrogates distinct within a kind and none of them a value.

    Each round keeps, of the values with one surrogate, the one that has had it longest; the others, and values whose surrogate is
    itself a value of the data, are tried again.
    """
    state = materialize(values.select("kind", "value", F.lit(0).alias("attempt")).withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)), "surrogates")
    originals = state.select(F.col("kind").alias("k"), F.col("value").alias("v"))
    for _ in range(rounds):
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "value"))
        known = state.join(originals, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("v")), "left")
        judged = known.withColumn("again", (first > 1) | F.col("v").isNotNull()).drop("k", "v")
        judged = materialize(judged, "surrogates")
        if judged.filter("again").isEmpty():
            return judged.select("kind", "value", "surrogate")
        attempt = F.col("attempt") + F.col("again").cast("int")
        redone = judged.withColumn("attempt", attempt)
        state = materialize(redone.withColumn("surrogate", F.when(F.col("again"), surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)).otherwise(F.col("surrogate"))).drop("again"), "surrogates")
    raise RuntimeError("no distinct surrogates found; the pattern lets through a kind with too few possible values")


def name_mailboxes(table: DataFrame) -> DataFrame:
    """``table`` with mailboxes made of names of the data (``john.smith``) named by the surrogates of these names.

    A mailbox keeps the surrogate it has where its new one would be that of another, or a mailbox of the data.
    """
    names = table.filter(F.col("kind").isin("given_m", "given_f", "given_x", "surname")).groupBy(F.lower("value").alias("known")).agg(F.min(F.struct("kind", "surrogate"))["surrogate"].alias("named"))
    boxes = table.filter("kind = 'mailbox'")
    parts = boxes.select("value", F.posexplode(F.split("value", "[._-]")).alias("n", "part"))
    made = parts.join(names, F.lower("part") == F.col("known"), "left").groupBy("value").agg(
        F.sort_array(F.collect_list(F.struct("n", F.lower("named").alias("named")))).alias("parts"), F.bool_and(F.col("named").isNotNull()).alias("whole")
    ).filter("whole")
    gaps = F.regexp_extract_all("value", F.lit("([._-])"), F.lit(1))
    new = F.array_join(F.transform("parts", lambda p, i: F.concat(p["named"], F.coalesce(F.get(gaps, i), F.lit("")))), "")
    made = made.select("value", new.alias("new"))
    taken = boxes.select(F.col("value").alias("other")).unionByName(boxes.select(F.col("surrogate").alias("other"))).distinct()
    made = made.withColumn("same", F.count("*").over(Window.partitionBy("new"))).join(taken, F.col("new") == F.col("other"), "left_anti").filter("same = 1")
    made = made.select(F.lit("mailbox").alias("k"), F.col("value").alias("v"), "new")
    return table.join(made, (F.col("kind") == F.col("k")) & (F.col("value") == F.col("v")), "left").select("kind", "value", F.coalesce("new", "surrogate").alias("surrogate"))


def replace(documents: DataFrame, *, key: str, text: str = "text", columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``documents`` (``columns``, all by default) with surrogates in ``text`` and a last column n_replaced; and the surrogates' table.

    Rows without a mention stay where they are; only rows with one are stored, and joined with their surrogates by a row number, so
    a value that very many rows mention is spread by adaptive skew joins and rows of one document meet only in that document's task.
    In rows with a name, the capitalised words between mentions are joined with that row's parts of names, by row number and word.

    Null and empty texts stay and have no mention; repeated rows are replaced each, alike; an empty table gives an empty one.
    ``n_replaced`` is the one name that is added; a column of that name is replaced.
    """
    names = [c for c in (columns or documents.columns) if c != "n_replaced"]
    rows = documents.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    place = f"c{names.index(text)}"
    body = F.coalesce(F.col(place).cast("string"), F.lit(""))
    found = F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0))
    stored = materialize(rows.filter(body.rlike(PATTERN)).withColumn("found", found).withColumn("row", F.monotonically_increasing_id()), "surrogates")
    mentions = stored.select("row", F.posexplode("found").alias("place", "mention"))
    known = materialize(mentions.groupBy("mention").agg(F.lit(1).alias("one")).select("mention", parts_of(F.col("mention")).alias("parts")), "surrogates")
    values = known.select(F.explode("parts").alias("p")).filter("p.kind IS NOT NULL").select("p.kind", "p.value").distinct()
    table = materialize(name_mailboxes(assign(values, key)), "surrogates")
    parts = known.select("mention", F.posexplode("parts").alias("n", "p")).select("mention", "n", F.col("p.kind").alias("k"), F.col("p.value").alias("v"))
    built = parts.join(table, (F.col("k") == F.col("kind")) & (F.col("v") == F.col("value")), "left").groupBy("mention").agg(
        F.sort_array(F.collect_list(F.struct("n", F.coalesce("surrogate", "v").alias("s")))).alias("s")
    ).select(F.col("mention").alias("m"), F.array_join(F.transform("s", lambda x: x["s"]), "").alias("new"))
    fills = mentions.join(materialize(built, "surrogates"), F.col("mention") == F.col("m")).groupBy(F.col("row").alias("of")).agg(F.sort_array(F.collect_list(F.struct("place", "new"))).alias("fills"))
    parts_here = mentions.filter(is_name(F.col("mention"))).join(parts.filter(F.length("v") > 1).withColumnRenamed("mention", "m"), F.col("mention") == F.col("m"))
    parts_here = parts_here.filter("k IS NOT NULL AND NOT endswith(v, '.')").filter(~F.col("v").isin(AMBIGUOUS))
    parts_here = parts_here.groupBy("row", F.lower("v").alias("low")).agg(F.max(F.struct("k", "v")).alias("p")).select("row", "low", "p.k", "p.v")  # one that is a surname, too, stands for that
    lower = stored.filter(F.exists("found", is_name)).select(F.col("row").alias("r"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(place), F.lit(LOWER_WORD), F.lit(0)))).alias("l"))
    parts_here = parts_here.join(lower, (F.col("row") == F.col("r")) & (F.col("low") == F.col("l")), "left_anti")  # a word of the language as well
    parts_here = parts_here.join(table, (F.col("k") == F.col("kind")) & (F.col("v") == F.col("value"))).select(F.col("row").alias("of"), "low", F.col("surrogate").alias("new"))
    between = stored.filter(F.exists("found", is_name)).select("row", F.posexplode(F.split(F.col(place), PATTERN, -1)).alias("gap", "text"))
    words = between.select("row", "gap", F.posexplode_outer(F.regexp_extract_all("text", F.lit(ALONE), F.lit(0))).alias("place", "word"))
    cased = F.when((F.length("word") > 1) & (F.upper("word") == F.col("word")), F.upper("new")).otherwise(F.col("new"))
    words = words.join(parts_here, (F.col("row") == F.col("of")) & (F.lower("word") == F.col("low")), "left").select("row", "gap", "place", F.coalesce(cased, "word").alias("word"), F.col("new").isNotNull().cast("int").alias("n"))
    texts = words.groupBy("row", "gap").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("words"), F.sum("n").alias("n"))
    texts = texts.groupBy(F.col("row").alias("named")).agg(F.sort_array(F.collect_list(F.struct("gap", "words"))).alias("again"), F.sum("n").alias("more")).filter("more > 0")
    joined = stored.join(fills, F.col("row") == F.col("of")).join(texts, F.col("row") == F.col("named"), "left")
    gaps = F.split(F.col(place), PATTERN, -1)

    def renamed(gap, again):
        return F.array_join(F.zip_with(F.split(gap, ALONE, -1), again["words"], lambda g, w: F.concat(g, F.coalesce(w["word"], F.lit("")))), "")

    gaps = F.when(F.col("again").isNull(), gaps).otherwise(F.zip_with(gaps, "again", renamed))
    filled = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size("fills")), "fills", lambda g, f: F.concat(g, f["new"])), ""), F.element_at(gaps, -1))
    n_replaced = (F.size("fills") + F.coalesce("more", F.lit(0))).cast("long").alias("n_replaced")
    changed = joined.select(*(filled.alias(f"c{i}") if n == text else F.col(f"c{i}") for i, n in enumerate(names)), n_replaced)
    same = rows.filter(~body.rlike(PATTERN)).withColumn("n_replaced", F.lit(0).cast("long"))
    return changed.unionByName(same).toDF(*names, "n_replaced"), table
