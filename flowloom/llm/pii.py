"""Personal data by weak supervision, with DataFrame functions only.

Base: four patterns (e-mail, ip, card, phone) with their checks; their spans stay as they are. Candidates for more
are tokens with a digit, letters without a digit behind a secret word or a sign (`=`, `:`; not the one of a URL's
scheme), and names: two or three words in capitals one after the other, or what follows a title. Tokens and names have
labelers of their own, which vote yes, no or nothing. Tokens: patterns (their shape), gazetteers (the words inside or
before) and contexts (signs before, base spans, bare numbers that no base check takes). Names: gazetteers (first names;
words in capitals that are no person's), titles, words of address or articles in front, verbs of people or marks of firms
behind, place in the sentence, endings, repetition. Spark counts how often each pattern of votes and features occurs over
all documents; the table of patterns is small by construction (see PATTERNS). Expectation-maximisation on it estimates
each labeler's reliability and each pattern's chance of being personal; Spark's LogisticRegression, weighted by these,
trains the final span classifiers on the features, and their weights are one expression. Spans that they accept are added
with kind `secret`; a name only if a gazetteer, a title, a word of address or a verb speaks for it.

Without a model given, the rows are written with their candidates to the shared folder, once; training and scoring read
these.

Positions: the pieces between matches and the matches themselves alternate; folds over blocks of them sum up code
points. Patterns use possessive repetition, look behind instead of starting inside a run, and read a context forwards
from its word or sign, so that each reads a text of any length once and needs no deep stack; the matches of the base
patterns are those of the plain ones.

Cases: a null text is empty and has no spans. Texts are never cut. Spans of different kinds may overlap. Repeated rows
count once for each row and give repeated rows. With no candidates at all nothing is added. An empty table gives no
rows. Other columns are not looked at; columns named as found()'s give way to them.
"""

from __future__ import annotations

import math
from collections import namedtuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import fresh, literal_rows, own_columns, table, written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns with possessive repetition. Where a match could begin inside a run of its first part, \G stands for the end of the match before.
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text has if it can have a match at all.
NEEDS = {
    "email": lambda text: F.contains(text, F.lit("@")),
    "ip": lambda text: text.rlike(r"[0-9]\.[0-9]"),
    "card": lambda text: text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda text: F.contains(text, F.lit("+")),
}
#: Gazetteers. Ours.
WORDS = "account|api[_-]?key|auth|credential|iban|licen[cs]e[_-]?key|login|pass(?:word|wd|phrase|port)|pin|pwd|secret|ssn|token"
SECRET_WORDS = rf"(?i)(?:^|[^a-z])(?:{WORDS})(?:$|[^a-z])"
PLAIN_WORDS = r"(?i)(?:^|[^a-z])(?:version|chapter|page|section|volume|figure|table|part|step|article|copyright|vol|no|line|item)(?:$|[^a-z])"
NAMES = (
    "Alice|Andrew|Anna|Anthony|Barbara|Carlos|Catherine|Charles|Christopher|Claire|Daniel|David|Elizabeth|Emily|Emma|Fatima|François|Françoise|Giovanni|Hans|Helen|Isabelle|James|Jennifer|Jessica|Johann|John|"
    "José|Joseph|Juan|Jürgen|Karen|Katharina|Laura|Linda|Lucía|Margaret|María|Mary|Matthew|Michael|Mohammed|Nancy|Nicolas|Olivia|Patricia|Pedro|Peter|Philippe|Pierre|Rebecca|Richard|Robert|Sarah|Stefan|Steven|"
    "Susan|Thomas|Ursula|William|Wolfgang"
)
TITLES = "Mr|Mrs|Ms|Dr|Prof|Mme|Mlle|Herr|Frau|Señor|Señora"
#: Tokens with a digit.
DIGITS = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
#: A secret word, with or without a sign or verb, or a sign alone; then, as group 1, a token of letters.
LETTERS = (
    rf"(?:[=:](?!//)|(?<![A-Za-z])(?=[aAcCiIlLpPsStT])(?i:{WORDS})(?![A-Za-z])[0-9]*+[\"']?(?:\s{{0,2}}[=:]|\s(?:is|was)(?=\s)|(?=\s)))\s{{0,2}}[\"'(]?"
    rf"(?!(?:(?i:{WORDS})(?![A-Za-z])|(?:is|was)\s))(\p{{L}}[^\s0-9]*+)(?!\S)"
)
#: Words in capitals that no person is called, in small letters; those before or after a name; what names and other words end in. Ours.
NO_NAMES = (
    "a|academy|air|an|and|apache|april|association|august|avenue|bank|bay|beach|bridge|castle|center|centre|chapter|church|city|club|college|committee|common|company|conditions|copyright|corporation|council|county|court|creative|customer|das|december|department|der|die|"
    "ein|eine|el|february|foundation|free|friday|für|general|government|great|group|hall|hill|house|il|in|inc|industries|institute|international|island|january|july|june|la|lake|las|law|le|league|les|library|license|los|ltd|march|market|may|ministry|monday|mount|museum|national|"
    "new|north|november|october|of|office|old|open|park|party|press|prize|public|river|road|royal|rue|saint|san|santa|saturday|school|sea|section|september|service|society|software|source|south|springs|square|state|station|street|sunday|support|team|terms|that|the|these|this|thursday|"
    "times|tower|tuesday|un|una|une|union|united|university|valley|version|war|wednesday|west|white"
)
ADDRESS = "(?:asked|author|called|contact|dear|hello|hi|met|named|name is|regards|signed|sincerely|told|(?:painted|signed|written) by|écrit par|escrito por|geschrieben von)"
ARTICLES = "(?:a|an|at|in|of|on|the|das|dem|den|der|des|die|ein|eine|el|la|las|le|les|los|un|una|une)"
VERBS = "(?:answered|asked|called|died|emailed|lived|lives|married|phoned|replied|said|says|signed|told|works|worked|wrote|was born|sagte|schrieb|wohnt|arbeitet|écrit|habite|travaille|dijo|escribió|vive|trabaja)"
NAME_ENDS = "(?:son|sen|mann|berg|stein|ez|ini|elli|ski|ova|ault|eau|ley|ton|ford)$"
OTHER_ENDS = "(?:tion|ment|ness|ity|ism|ing|ung|heit|keit|ción|dad|logy|ics|ies)$"
#: What follows a title as group 1, or two or three words in capitals. A first name alone may be a place, a figure or a principle.
NAME_WORD = r"(?:Mc|Mac|[DO]['’])?\p{Lu}\p{Ll}++(?:[-'’]\p{Lu}\p{Ll}++)*+(?!\p{L})"
NEXT = rf"\x20(?:(?:da|de|del|di|la|van|von)\x20)?{NAME_WORD}"
NAMED = rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?:{TITLES})\.?\x20(?!(?:{TITLES})\.?\x20)({NAME_WORD}(?:{NEXT})?+)|{NAME_WORD}(?:{NEXT}){{1,2}}+)"
#: Labelers, then features of shape: each is -1, 0 or 1, so there are at most 3**10 patterns.
LABELERS = ("by_shape", "by_length", "by_secret_word", "by_plain_word", "by_sign", "by_base")
FEATURES = (*LABELERS, "letters_and_digits", "long", "quoted", "number_only")
#: The first PERSON of the names' labelers speak for a person by themselves.
NAME_LABELERS = ("by_list", "by_title", "by_address", "by_verb", "by_place", "by_ending", "by_repeat")
NAME_FEATURES = (*NAME_LABELERS, "three_words", "long")
PERSON = 4
PATTERNS = 3 ** len(FEATURES) + 3 ** len(NAME_FEATURES)
#: Weights and intercept of the classifier of tokens, then of names.
Model = namedtuple("Model", "tokens names")


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pieces(text: Column, pattern: str, block: int = 512, behind: int = 0) -> Column:
    """array of struct (start, end, value, before) of the matches; before: the last 24 code points between it and the match in front. With behind also after: as many code points up to the next match.

    A fold copies what it has at each step, so it goes over blocks of matches, and a second one over the blocks.
    """
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    kind = f"struct<at:int,spans:array<struct<start:int,end:int,value:string,before:string{',after:string' if behind else ''}>>>"
    none = F.struct(F.lit(0).alias("at"), F.array().alias("spans")).cast(kind)

    def step(held: Column, pair: Column) -> Column:
        start = held["at"] + F.char_length(pair["gap"])
        after = [F.left(pair["next"], F.lit(behind)).alias("after")] if behind else []
        one = F.struct(start.alias("start"), (start + F.char_length(pair["value"])).alias("end"), pair["value"].alias("value"), F.right(pair["gap"], F.lit(24)).alias("before"), *after)
        return F.struct(one["end"].alias("at"), F.concat(held["spans"], F.array(one)).alias("spans")).cast(kind)

    def of_block(pairs: Column) -> Column:
        return F.aggregate(pairs, none, step)

    def moved(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), *[s[c].alias(c) for c in ("value", "before", *(["after"] if behind else []))]))

    def put_together(parts: Column) -> Column:
        starts = F.aggregate(parts, F.array(F.lit(0)), lambda held, p: F.concat(held, F.array(F.element_at(held, -1) + p["at"])))
        return let(starts, lambda at: F.flatten(F.transform(parts, lambda p, i: moved(p["spans"], F.get(at, i)))))

    def all_of(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / block).cast("int")), lambda i: of_block(F.slice(pairs, i * block + 1, F.lit(block))))
        return F.when(F.size(pairs) <= block, of_block(pairs)["spans"]).otherwise(let(blocks, put_together))

    if behind:
        return let(gaps, lambda g: let(F.arrays_zip(values.alias("value"), F.slice(g, 1, F.size(g) - 1).alias("gap"), F.slice(g, 2, F.size(g) - 1).alias("next")), all_of))
    return let(F.arrays_zip(values.alias("value"), let(gaps, lambda g: F.slice(g, 1, F.size(g) - 1)).alias("gap")), all_of)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether a string of digits passes: from the right every second digit counts double, less 9 if above 9; the sum ends in 0."""
    turned = F.reverse(value)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(value)), F.lit(0), step) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    n = F.char_length(digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return n.between(14, 19) & luhn(digits(value))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def base_spans(text: Column) -> Column:
    """The base spans by start, then kind."""

    def of(rank: int, kind: str) -> Column:
        found = F.filter(pieces(text, PATTERN[kind]), lambda m: valid(kind, m["value"]))
        spans = F.transform(found, lambda m: F.struct(m["start"], F.lit(rank).alias("rank"), m["end"], F.lit(kind).alias("kind"))).cast(SPAN)
        return F.when(NEEDS[kind](text), spans).otherwise(F.array().cast(SPAN))

    email, *others = [of(rank, kind) for rank, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(email, F.when(text.rlike("[0-9]"), F.concat(*others)).otherwise(F.array().cast(SPAN))))


def vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(no if no is not None else F.lit(False), -1).otherwise(0)


NAME_CANDIDATES = f"array<struct<start:int,end:int,base:boolean,{','.join(f'{f}:int' for f in NAME_FEATURES)}>>"
CANDIDATES = f"array<struct<start:int,end:int,base:boolean,{','.join(f'{f}:int' for f in FEATURES)}>>"


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < end) & (b["end"] > start))


def with_digits(text: Column, base: Column) -> Column:
    """CANDIDATES of the tokens with a digit. A leading `word=` or quote is part of the token, not of the span."""

    def one(m: Column) -> Column:
        value = m["value"]
        core = F.regexp_extract(value, r"([A-Za-z0-9][A-Za-z0-9_./+-]*+)[^A-Za-z0-9]*$", 1)
        end = m["end"] - F.char_length(F.regexp_extract(value, r"([^A-Za-z0-9]*)$", 1))
        start = end - F.char_length(F.regexp_replace(core, r"[^A-Za-z0-9]+$", ""))
        near = F.concat(m["before"], F.lit(" "), F.regexp_replace(value, r"[=:].*$", "="))
        n, d = F.char_length(core), F.char_length(digits(core))
        inside, word = overlaps(base, m["start"], m["end"]), near.rlike(SECRET_WORDS)
        mixed, social = core.rlike("[A-Za-z]") & core.rlike("[0-9]"), core.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
        bare = ~core.rlike("[A-Za-z]") & ~word & ~social  # a number that no base check takes
        return F.struct(
            start.cast("int").alias("start"), end.cast("int").alias("end"), inside.alias("base"),
            vote(inside | (mixed & core.rlike(r"^[A-Za-z0-9_-]{16,}$")) | social, core.rlike(r"^[0-9]{1,4}$") | core.rlike(r"^[0-9]+(?:[.,][0-9]+)+$")).alias("by_shape"),
            vote((n >= 10) & (mixed | inside | social), n <= 5).alias("by_length"),
            vote(word).alias("by_secret_word"),
            vote(F.lit(False), near.rlike(PLAIN_WORDS)).alias("by_plain_word"),
            vote(near.rlike(r"[=:]\s*\"?\s*$"), near.rlike(r"[a-z],?\s+$") & (n <= 5)).alias("by_sign"),
            vote(inside, (bare | (d <= 2)) & ~inside).alias("by_base"),
            vote(mixed, ~core.rlike("[A-Za-z]")).alias("letters_and_digits"),
            vote(n >= 14, n <= 8).alias("long"), vote(value.rlike("[\"']")).alias("quoted"), vote(core.rlike("^[0-9]+$")).alias("number_only"),
        )

    return F.when(text.rlike("[0-9]"), F.transform(pieces(text, DIGITS), one).cast(CANDIDATES)).otherwise(F.array().cast(CANDIDATES))


def with_letters(text: Column, base: Column) -> Column:
    """CANDIDATES behind secret words and signs: a word and a sign together speak for a token of letters, one of them alone against it."""

    def one(m: Column) -> Column:
        value = F.regexp_extract(m["value"], LETTERS, 1)
        context = F.left(m["value"], F.char_length(m["value"]) - F.char_length(value))
        start, core = m["end"] - F.char_length(value), F.regexp_replace(value, r"[^\p{L}]+$", "")
        word, n = ~context.rlike("^[=:]"), F.char_length(core)
        quoted, end = context.rlike("[\"']$"), start + n
        sign = context.rlike("[=:]") | (context.rlike(r"\s(?:is|was)\s") & quoted)  # a verb alone goes before any word
        inside, yes = overlaps(base, start, end), word & sign
        return F.struct(
            start.alias("start"), end.alias("end"), inside.alias("base"), vote(inside | yes, ~yes).alias("by_shape"), vote(n >= 10, n <= 5).alias("by_length"), vote(word).alias("by_secret_word"),
            vote(F.lit(False), ~yes).alias("by_plain_word"), vote(sign, ~sign & (n <= 5)).alias("by_sign"), vote(inside).alias("by_base"), F.lit(0).alias("letters_and_digits"),
            vote(n >= 14, n <= 8).alias("long"), vote(quoted).alias("quoted"), F.lit(0).alias("number_only"),
        )

    return F.when(text.rlike(LETTERS), F.transform(pieces(text, LETTERS), one).cast(CANDIDATES)).otherwise(F.array().cast(CANDIDATES))


def with_names(text: Column, base: Column) -> Column:
    """NAME_CANDIDATES: words in capitals one after the other, and what follows a title."""

    def one(m: Column) -> Column:
        titled = F.regexp_extract(m["value"], NAMED, 1)
        value = F.when(titled != "", titled).otherwise(m["value"])
        start, n = m["end"] - F.char_length(value), F.char_length(value)
        before, after = m["before"], m["after"]
        return F.struct(
            start.alias("start"), m["end"].alias("end"), overlaps(base, start, m["end"]).alias("base"),
            vote(value.rlike(rf"^(?:{NAMES})\x20") & ~value.rlike(rf"(?i)(?:^|\x20)(?:{NO_NAMES})(?:$|\x20)"), value.rlike(rf"(?i)(?:^|\x20)(?:{NO_NAMES})(?:$|\x20)")).alias("by_list"),
            vote(titled != "").alias("by_title"),
            vote(before.rlike(rf"(?i)(?<!\p{{L}}){ADDRESS}:?,?\s$"), before.rlike(rf"(?i)(?<!\p{{L}}){ARTICLES}\s$")).alias("by_address"),
            vote(after.rlike(rf"^,?\s{VERBS}(?!\p{{L}})"), after.rlike(r"^,?\s(?:AG|Co|GmbH|Inc|LLC|Ltd|SA|of)(?!\p{L})")).alias("by_verb"),
            vote(before.rlike(r"[\p{Ll},;]\x20$"), before.rlike(r"^$|[.!?:\n]\s*$")).alias("by_place"),
            vote(value.rlike(NAME_ENDS), value.rlike(OTHER_ENDS)).alias("by_ending"),
            vote(F.lit(False), value.rlike(r"(?:^|\x20)(\p{L}++)\x20\1(?:$|\x20)")).alias("by_repeat"),
            vote(value.rlike(r"\x20.*\x20"), ~value.rlike(r"\x20")).alias("three_words"), vote(n >= 18, n <= 8).alias("long"),
        )

    return F.when(text.rlike(NAMED), F.transform(pieces(text, NAMED, behind=16), one).cast(NAME_CANDIDATES)).otherwise(F.array().cast(NAME_CANDIDATES))


def reliabilities(patterns: list[tuple[tuple[int, ...], float]], n: int = len(LABELERS), held: float = 0.0, rounds: int = 50) -> tuple[list[dict], float, list[float]]:
    """Expectation-maximisation over (votes, count): for each labeler the chances of -1, 0, 1 for personal and other tokens; the share of personal ones; each pattern's chance.

    The first n entries of a pattern are votes. The start trusts every labeler a little; counts are smoothed by one of
    each vote or, with held, by as many as that in the shares of the start, so that few rows don't turn a labeler round.
    """
    first = {1: {1: 0.6, 0: 0.3, -1: 0.1}, 0: {1: 0.1, 0: 0.3, -1: 0.6}}
    trust = [dict(first) for _ in range(n)]
    share, chance = 0.5, [0.5] * len(patterns)
    for _ in range(rounds):
        for at, (votes, _) in enumerate(patterns):
            odds = math.log(share / (1 - share)) + sum(math.log(trust[i][1][v] / trust[i][0][v]) for i, v in enumerate(votes[:n]))
            chance[at] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        total = sum(c for _, c in patterns)
        share = min(0.999, max(0.001, sum(c * q for (_, c), q in zip(patterns, chance, strict=True)) / total))
        for i in range(n):
            for side in (1, 0):
                sums = {v: held * first[side][v] if held else 1.0 for v in (1, 0, -1)}
                for (votes, c), q in zip(patterns, chance, strict=True):
                    sums[votes[i]] += c * (q if side else 1 - q)
                trust[i][side] = {v: s / sum(sums.values()) for v, s in sums.items()}
    return trust, share, chance


def classifier(spark, patterns: list[tuple[tuple[int, ...], float]], features: tuple[str, ...], chance: list[float], weight) -> tuple[list[float], float]:
    """Weights of the features and intercept of a logistic regression; weight(count) is a pattern's."""
    rows = [(*map(float, v), label, weight(c) * w) for (v, c), q in zip(patterns, chance, strict=True) for label, w in ((1.0, q), (0.0, 1 - q)) if c * w > 0]
    data = literal_rows(spark, {c: [r[i] for r in rows] for i, c in enumerate((*features, "label", "weight"))})
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(data)
    model = LogisticRegression(maxIter=50, regParam=0.001, weightCol="weight", standardization=False).fit(data)
    return [float(x) for x in model.coefficients], float(model.intercept)


def train(rows: DataFrame) -> Model:
    """The span classifiers. rows: columns `candidates` and `names`. Names are rare among words in capitals, so their patterns weigh by the logarithm of their counts."""

    def patterns_of(column: str, sort: int, features: tuple[str, ...]) -> Column:
        return F.transform(column, lambda c: F.struct(F.lit(sort).alias("sort"), F.array(*[c[f] for f in features]).alias("votes")))

    both = F.concat(patterns_of("candidates", 0, FEATURES), patterns_of("names", 1, NAME_FEATURES))
    # The outer form: else a filter on the list's size is put below and works the candidates out once more.
    counts = rows.select(F.explode_outer(both).alias("c")).where("c IS NOT NULL").groupBy("c.sort", "c.votes").count().orderBy("sort", "votes").collect()
    out = []
    for sort, features, labelers, held, weight in ((0, FEATURES, len(LABELERS), 0.0, float), (1, NAME_FEATURES, len(NAME_LABELERS), 20.0, math.log1p)):
        patterns = [(tuple(r.votes), float(r["count"])) for r in counts if r.sort == sort]
        none = ([0.0] * len(features), -1.0)
        out.append(classifier(rows.sparkSession, patterns, features, reliabilities(patterns, labelers, held)[2], weight) if patterns else none)
    return Model(*out)


def score(c: Column, features: tuple[str, ...], weights: tuple[list[float], float]) -> Column:
    out = F.lit(weights[1])
    for f, w in zip(features, weights[0], strict=True):
        out = out + c[f] * F.lit(w)
    return out


def found(docs: DataFrame, text_col: str = "text", model: Model | None = None, base_col: str = "pii_base", spans_col: str = "pii_spans") -> DataFrame:
    """docs with base_col (base spans) and spans_col (base and added), arrays of struct (start, rank, end, kind) by start and kind, behind its columns."""
    text, base, names, candidates = (fresh(docs, c) for c in ("the_text", "base", "names", "candidates"))
    rows = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = rows.withColumn(base, base_spans(F.col(text)))
    rows = rows.withColumn(names, with_names(F.col(text), F.col(base)))
    rows = rows.withColumn(candidates, F.concat(with_digits(F.col(text), F.col(base)), with_letters(F.col(text), F.col(base))))
    if model is None:  # training and scoring read what is written: else both plans hold all patterns, and work them out
        rows = written(rows.select(*own_columns(docs), base, names, candidates), "candidates")
    use = model or train(rows.select(F.col(candidates).alias("candidates"), F.col(names).alias("names")))

    def spans(accepted: Column) -> Column:
        return F.transform(accepted, lambda c: F.struct(c["start"], F.lit(len(KINDS)).alias("rank"), c["end"], F.lit("secret").alias("kind"))).cast(SPAN)

    def is_name(c: Column) -> Column:
        return ~c["base"] & (score(c, NAME_FEATURES, use.names) > 0) & (F.greatest(*[c[f] for f in NAME_LABELERS[:PERSON]]) > 0)

    def added(persons: Column) -> Column:
        apart = lambda c: (F.size(persons) == 0) | ~overlaps(persons, c["start"], c["end"])
        tokens = F.filter(candidates, lambda c: ~c["base"] & (score(c, FEATURES, use.tokens) > 0) & (c["end"] > c["start"]) & apart(c))
        return F.array_sort(F.concat(F.col(base), persons, spans(tokens)))

    return rows.select(*own_columns(docs, (base_col, spans_col)), F.col(base).alias(base_col), let(spans(F.filter(names, is_name)), added).alias(spans_col))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; what overlaps an earlier span goes with it."""
    kind = "struct<at:int,out:string>"

    def step(held: Column, s: Column) -> Column:
        before = F.substring(text, held["at"] + 1, s["start"] - held["at"])
        out = F.when(s["start"] >= held["at"], F.concat(held["out"], before, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(held["out"])
        return F.struct(F.greatest(s["end"], held["at"]).alias("at"), out.alias("out")).cast(kind)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(kind)
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda held: F.concat(held["out"], F.substr(text, held["at"] + 1))))


def op7_pii(spark, sf_dir):
    out = found(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("pii_base")), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"))
