"""Personal data replaced by keyed surrogates, in DataFrame operations only.

Detected: e-mail and IPv4 addresses, telephone, card and social-security numbers, secrets (long hexadecimal
strings, values given to names like token, common key prefixes), names after a title, and wherever else
in the same text their words stand with a capital.
A surrogate is a keyed hash written in the entity's own shape: digits stay digits, letters stay
letters of their case and script, separators, country codes and octet ranges stay, card numbers
that satisfy the check digit keep doing so, first names keep the title's gender. Initials get a keyed
letter each; they are no entities, as there are too few letters to keep them apart.

Coreference: an entity is its lower-cased text and type; the words of a name are entities of
their own, the same as first and as last name, so a surname alone and after a first name agree. A word that
is a first name after titles of both genders gets a surrogate of none. Distinctness: all distinct entities
of the corpus are checked; one whose surrogate another entity got, or is an entity of the
corpus itself, gets a new one, until none is left.

Only occurrences and distinct entities are shuffled besides the texts that hold any.

Defined results: null and empty texts stay as they are, with 0 entities; equal texts are replaced equally, repeated
rows included. If a type runs out of surrogates after MAX_ROUNDS attempts, ValueError.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from farebox.llm.common import cut, fresh

KEY = "farebox"
MAX_ROUNDS = 40
# Titles by gender.
MALE = ["Mr", "Mister", "Sir", "Herr", "Herrn", "Señor", "Sr", "Don", "Monsieur", "М-р", "Господин", "Г-н", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Señorita", "Doña", "Madame", "Mme", "Mademoiselle",
          "Mlle", "Госпожа", "Г-жа", "Κυρία"]
OPEN = ["Dr", "Prof", "Доктор"]

_TITLE = rf"(?:{'|'.join(sorted(MALE + FEMALE + OPEN, key=len, reverse=True))})"
_SPACE = r"[\s\p{Z}]"
#: Between the words of a name: blanks and at most one line end.
_GAP = r"(?:[ \t\p{Zs}]++(?:\r?\n[ \t\p{Zs}]*+)?|\r?\n[ \t\p{Zs}]*+)"
_END = r"(?![\p{L}\p{M}])"
_AGAIN = rf"(?:{'|'.join(OPEN)})"
_WORD = rf"(?!{_AGAIN}{_END})\p{{Lu}}(?:[\p{{L}}\p{{M}}]|['’-](?=\p{{Lu}}))++"
_INITIALS = rf"(?:(?:\p{{Lu}}\.(?:-?\p{{Lu}}\.)*+{_GAP}?|\p{{Lu}}(?![\p{{L}}\p{{M}}'’-]){_GAP}){{0,3}})"
#: No further word of a name: the title of the next one. Don is a first name too.
_OTHER = rf"(?!(?:{'|'.join(sorted({*MALE, *FEMALE, *OPEN} - {'Don'}, key=len, reverse=True))}){_END})"
_LOCAL = r"[\p{L}\p{N}._%+-]"
_CARD = r"(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5})"
PATTERNS = [
    rf"(?<!{_LOCAL}){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    r"(?<![.])(?=\d)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    # all groups of digits that follow, so that no end of a number stays; a card behind it is an entity of its own
    rf"\+(?={'|'.join(rf'\d{{{k}}}\)?[ .-]?\(?\d(?:\)?[ .-]?\d){{{6 - k}}}' for k in (1, 2, 3))})"  # 7 digits at least
    r"\d{1,3}(?:\)(?=[ .-]?\d))?[ .-]?\(?\d{1,5}(?:\)(?=[ .-]?\d))?"
    rf"(?:\d|[ .-](?!{_CARD}(?![\p{{L}}\p{{N}}]))\d)++",
    r"\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
    r"(?<!-)\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])",
    rf"{_CARD}(?![\p{{L}}\p{{N}}])",
    r"(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![\p{L}\p{N}])",
    r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9_-]{20,}+)",
    r"(?=[A-Za-z0-9_/+.-]{12})(?<=(?i:token|secret|password|passwd|api_key|apikey)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)"
    r"[A-Za-z0-9_/+.-]{12,}+",
    rf"(?=[{''.join(sorted({t[0] for t in MALE + FEMALE + OPEN}))}]){_TITLE}\.?{_SPACE}++(?:{_AGAIN}\.?{_SPACE}++)*"
    rf"{_INITIALS}{_WORD}(?:{_GAP}{_OTHER}{_INITIALS}{_WORD}){{0,2}}",
]
#: The title, words, initials and white space of a name.
_TOKENS = rf"{_SPACE}++|(?:-?\p{{Lu}}\.)++|(?:(?!{_SPACE}).)++"

#: Every entity starts where no letter or digit stands before.
PATTERN = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for p in PATTERNS) + ")"
_TITLES = sorted(MALE + FEMALE + OPEN)
_FIRST = sorted({t[0] for t in _TITLES})
#: What every entity holds one of. Each pattern begins with one class of characters and is searched for on its
#: own: a joint alternation is tried whole at every letter and takes as long as the entities themselves.
HINTS = [
    r"[\d@_=:+-](?:(?<=@)|(?<=\+)\d|(?<=\d)[\d.]|(?<=gh[pousr]_)|(?<=sk-)|(?<=(?i:token|secret|password|passwd|api_?key)[\"']?\s{0,2}[=:]))",
    rf"[{''.join(_FIRST)}](?<!\p{{L}}.)(?:"
    + "|".join(rf"(?<={i})(?:{'|'.join(t[1:] for t in _TITLES if t[0] == i)})" for i in _FIRST) + rf")\.?{_SPACE}++\p{{Lu}}",
    r"[0-9a-fA-F]{32}",
]

_HEX = "0123456789abcdef"
_CONSONANTS = "bdfgklmnprstvzhj"
_VOWELS = "aeiouaeiouaeioua"
_LETTERS = "aeioubdfgklmnprs"
_CYRILLIC = "аеиоубдфгклмнпрс"
_GREEK = "αειουβδφγκλμνπρς"


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def _kind(hit: Column) -> Column:
    return (F.when(hit.contains("@"), "email")
            .when(hit.rlike(rf"^{_TITLE}\.?{_SPACE}"), "name")
            .when(hit.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
            .when(hit.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
            .when(hit.rlike(rf"^{_CARD}$"), "card")
            .when(hit.rlike(r"^[+(\d][\d ().+-]*$"), "phone")
            .when(hit.rlike(r"^([0-9a-f]+|[0-9A-F]+)$"), "hex").otherwise("secret"))


def _luhn(digits: Column) -> Column:
    """The check sum of a string of digits, modulo 10; 0 for valid card numbers."""
    at = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(at, F.lit(0), lambda s, x: s + x) % 10


def _shaped(text: Column, h: Column, hexadecimal: Column, kept: Column) -> Column:
    """`text` (lower case) with every digit and letter after the first `kept` characters replaced."""
    figures = F.translate(h, _HEX, "0123456789012345")
    hexes = F.translate(h, _HEX, "abcdefabcdefabcd")
    letters = F.translate(h, _HEX, _LETTERS)

    def one(c: Column, i: Column) -> Column:
        at = (i % 64 + 1).cast("int")
        letter = F.substring(F.when(hexadecimal, hexes).otherwise(letters), at, F.lit(1))
        return (F.when(i < kept, c).when(c.rlike(r"^\d$"), F.substring(figures, at, F.lit(1)))
                .when(c.rlike(r"^\p{IsCyrillic}$"), F.translate(letter, _LETTERS, _CYRILLIC))
                .when(c.rlike(r"^\p{IsGreek}$"), F.translate(letter, _LETTERS, _GREEK))
                .when(c.rlike(r"^\p{L}$"), letter).otherwise(c))

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def surrogate(kind: Column, entity: Column, attempt: Column, secret: str = KEY) -> Column:
    """The replacement of a lower-cased entity, in lower case."""
    h = _hash(F.lit(secret), kind, attempt.cast("string"), entity)

    def octet(k: int) -> Column:
        return (F.conv(F.substring(h, 4 * k + 1, 4), 16, 10).cast("int") % 254 + 1).cast("string")

    domain = F.substring_index(entity, "@", -1)
    ending = F.regexp_extract(domain, r"\.(com|org|net)$", 1)
    mail = F.concat(_shaped(F.substring_index(entity, "@", 1), h, F.lit(False), F.lit(0)), F.lit("@"),
                    F.translate(F.substring(_hash(F.lit(secret), F.lit("domain"), domain), 1, 8), _HEX, _LETTERS),
                    F.lit(".example."), F.when(ending == "", "org").otherwise(ending))
    plain = _shaped(entity, h, kind == "hex", F.when(kind == "phone", F.length(F.regexp_extract(entity, r"^\+\d{1,3}(?=[ .(-])", 0))).otherwise(0))
    # a card keeps the state of its check digit: the last digit takes up the difference
    digits = F.regexp_replace(plain, r"\D", "")
    valid = _luhn(F.regexp_replace(entity, r"\D", "")) == 0
    last = F.pmod(F.right(digits, F.lit(1)).cast("int") - _luhn(digits), F.lit(10)).cast("string")
    card = F.when(valid, F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), last)).otherwise(plain)
    syllables = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2) + attempt), lambda i: F.concat(
        F.translate(F.substring(h, (2 * i % 60 + 1).cast("int"), F.lit(1)), _HEX, _CONSONANTS),
        F.translate(F.substring(h, (2 * i % 60 + 2).cast("int"), F.lit(1)), _HEX, _VOWELS))), "")
    name = F.concat(syllables, F.when(kind == "name_f", "na").when(kind == "name_m", "n").when(kind == "name_o", "l").otherwise("rs"))
    latin, cyrillic, greek = ("abdefghijklmnoprstuvz", "абдефгхийклмнопрстувз", "αβδεφγχιικλμνοπρστουζ"[:21])
    name = (F.when(entity.rlike(r"\p{IsCyrillic}"), F.translate(name, latin, cyrillic))
            .when(entity.rlike(r"\p{IsGreek}"), F.translate(name, latin, greek)).otherwise(name))
    return (F.when(kind == "email", mail).when(kind == "ip", F.concat_ws(".", *map(octet, range(4))))
            .when(kind == "card", card).when(kind.startswith("name"), name).otherwise(plain))


def _like(s: Column, original: Column) -> Column:
    """The surrogate in the letter case of the original."""
    same = F.array_join(F.zip_with(F.split(s, ""), F.split(original, ""),
                                   lambda a, b: F.when(b.rlike(r"^\p{Lu}$"), F.upper(a)).otherwise(a)), "")
    return (F.when(original == F.lower(original), s).when(original == F.upper(original), F.upper(s))
            .when(F.length(s) == F.length(original), same).otherwise(F.initcap(s)))


def hinted(text: Column) -> Column:
    """Whether `text` may hold an entity; null holds none. Most texts are passed over by this alone."""
    tests = [text.contains("AKIA")] + [text.rlike(p) for p in HINTS]
    return F.coalesce(reduce(Column.__or__, tests), F.lit(False))


def _titled(hit: Column) -> Column:
    """The lower-cased words of the name that `hit` is; none of other hits."""
    tokens = F.regexp_extract_all(hit, F.lit(_TOKENS), F.lit(0))
    words = F.filter(F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda w: w.rlike(rf"^{_WORD}$"))
    return F.when(_kind(hit) == "name", F.transform(words, F.lower)).otherwise(F.array().cast("array<string>"))


def _pattern(names: Column) -> Column:
    """PATTERN, and the mentions of `names` without a title; of two words with one beginning the longer is tried first."""
    mention = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?=\p{Lu})(?iu:"), F.array_join(F.sort_array(names, asc=False), "|"),
                       F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    return F.when(F.size(names) > 0, mention).otherwise(F.lit(PATTERN))


def occurrences(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, mark (hash of the text), names (the words of its names) and hits of every distinct text with entities."""
    hits, names, whole = fresh(docs, "_hits", "_names", "_text")
    found = docs.where(hinted(F.col(text))).select(
        "doc_id", F.col(text).alias(whole), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias(hits))
    found = found.where(F.size(hits) > 0).withColumn(names, F.array_distinct(F.flatten(F.transform(hits, _titled))))
    all_hits = F.when(F.size(names) == 0, F.col(hits)).otherwise(F.regexp_extract_all(whole, _pattern(F.col(names)), F.lit(0)))
    return found.select("doc_id", F.xxhash64(whole).alias("mark"), F.sort_array(names).alias("names"), all_hits.alias("hits"))


def parts(hits: DataFrame) -> DataFrame:
    """One row per entity of `hits`: doc_id, mark, i (the hit), j (its part), original, kind, type and entity.

    Titles and white space are parts without kind; the names' words are entities of their own.
    """
    at = hits.select("doc_id", "mark", "names", F.posexplode("hits").alias("i", "hit"))
    mention = F.array_contains("names", F.lower("hit"))
    at = at.withColumn("type", F.when(mention, "mention").otherwise(_kind(F.col("hit")))).drop("names")
    words = F.regexp_extract_all("hit", F.lit(_TOKENS), F.lit(0))
    title = F.regexp_replace(words[0], r"\.$", "")
    gender = F.when(title.isin(*MALE), "name_m").when(title.isin(*FEMALE), "name_f").otherwise("name_o")
    one = F.when(F.col("type") == "name", words).otherwise(F.array("hit"))
    out = (at.withColumn("gender", gender).withColumn("n", F.size(one))
           .select("doc_id", "mark", "i", "type", "gender", "n", F.posexplode(one).alias("j", "original")))
    word = F.col("original")
    kind = (F.when(F.col("type") == "mention", "name_s").when(F.col("type") != "name", F.col("type"))
            .when((F.col("j") == 0) | word.rlike(rf"^{_SPACE}"), F.lit(None)).when(word.rlike(r"^((-?\p{Lu}\.)+|\p{Lu})$"), "initial")
            .when(~word.rlike(rf"^{_WORD}$"), F.lit(None))
            .when(F.col("j") == F.col("n") - 1, "name_s").otherwise(F.col("gender")))
    out = out.select("doc_id", "mark", "i", "j", "original", kind.alias("kind"), F.lower("original").alias("entity"))
    return out.withColumn("type", F.when(F.col("kind").startswith("name"), "name").otherwise(F.col("kind")))


def entity_map(found: DataFrame, secret: str = KEY) -> DataFrame:
    """type, entity and surrogate of every distinct entity; surrogates are distinct and no entities."""
    genders = F.array_remove(F.array_remove(F.collect_set("kind"), "name_s"), "name_o")
    kind = (F.when(F.col("type") != "name", F.col("type")).when(F.size(genders) == 1, genders[0])
            .when((F.size(genders) > 1) | F.array_contains(F.collect_set("kind"), "name_o"), "name_o").otherwise("name_s"))
    now = cut(found.where("kind <> 'initial'").groupBy("type", "entity").agg(kind.alias("kind"))
              .withColumn("attempt", F.lit(0))
              .withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), secret)), "entities")
    known = now.select(F.col("entity").alias("is")).distinct()
    for _ in range(MAX_ROUNDS):
        # an entity keeps a shared surrogate if it stands first
        later = F.row_number().over(W.partitionBy("surrogate").orderBy("attempt", "kind", "entity")) > 1
        seen = (now.withColumn("later", later).join(known, now["surrogate"] == known["is"], "left")
                .withColumn("bad", F.col("later") | F.col("is").isNotNull()))
        if seen.where("bad").isEmpty():
            return now.select("type", "entity", "surrogate")
        tried = F.col("attempt") + F.col("bad").cast("int")
        now = cut(seen.select("type", "kind", "entity", tried.alias("attempt"), F.when(
            F.col("bad"), surrogate(F.col("kind"), F.col("entity"), tried, secret)).otherwise(F.col("surrogate")).alias("surrogate")), "entities")
    raise ValueError(f"no distinct surrogates after {MAX_ROUNDS} rounds")


def replace_entities(docs: DataFrame, text: str = "text", secret: str = KEY, count: str | None = None) -> DataFrame:
    """`docs` with every entity in `text` replaced; `count` names an optional column of how many."""
    hits = cut(occurrences(docs, text).distinct(), "occurrences")
    found = cut(parts(hits), "parts")
    mapped = found.join(entity_map(found, secret), ["type", "entity"], "left")
    letter = _shaped(F.col("entity"), _hash(F.lit(secret), F.col("type"), F.col("entity")), F.lit(False), F.lit(0))
    s = F.when(F.col("type") == "initial", letter).otherwise(F.col("surrogate"))
    written = F.when(s.isNull(), F.col("original")).otherwise(_like(s, F.col("original")))
    d, m, new, names = fresh(docs, "_d", "_m", "_new", "_names")
    made = (mapped.groupBy(F.col("doc_id").alias(d), F.col("mark").alias(m))
            .agg(F.array_sort(F.collect_list(F.struct("i", "j", written.alias("s")))).alias(new),
                 F.collect_set(F.when(F.col("type") == "name", F.col("entity"))).alias(names)))
    may = hinted(F.col(text))
    some = docs.where(may).join(made, docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs[text]) == F.col(m)), "left")
    gaps, = fresh(some, "_gaps")
    some = some.withColumn(gaps, F.when(F.col(new).isNotNull(), F.split(text, _pattern(F.col(names)), -1)))
    filled = F.concat(F.array_join(F.transform(new, lambda p: F.concat(F.when(
        p["j"] == 0, F.get(F.col(gaps), p["i"])).otherwise(F.lit("")), p["s"])), ""), F.element_at(gaps, -1))
    hits_in = F.coalesce(F.size(F.filter(new, lambda p: p["j"] == 0)), F.lit(0))
    whole = {text: F.when(F.col(new).isNull(), F.col(text)).otherwise(filled)}
    none = docs.where(~may)
    if count:
        whole[count] = F.when(F.col(new).isNull(), F.lit(0)).otherwise(hits_in)
        none = none.withColumn(count, F.lit(0))
    return reduce(DataFrame.unionByName, [some.withColumns(whole).drop(d, m, new, names, gaps), none])
