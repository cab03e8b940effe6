"""Rules over a document corpus. Rule tables are data; one pass over a text tests all of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stewardry.functions.text import normalised
from stewardry.operators.checks import fail_closed
from stewardry.scale import cut


@dataclass(frozen=True)
class TextRule:
    """``require_all``, ``require_any`` or ``forbid`` a list of phrases (or one list of patterns)."""

    name: str
    mode: str
    terms: Sequence[str] = ()
    patterns: Sequence[str] = ()

    def passed(self, text: Column) -> Column:
        hits = [text.contains(t.lower()) for t in self.terms] + [text.rlike(p) for p in self.patterns]
        if not hits:
            raise ValueError(f"rule {self.name!r} lists nothing to look for")
        out = hits[0]
        if self.mode == "require_all":
            for hit in hits[1:]:
                out = out & hit
            return out
        if self.mode not in ("require_any", "forbid"):
            raise ValueError(f"unknown mode {self.mode!r}")
        for hit in hits[1:]:
            out = out | hit
        return out if self.mode == "require_any" else ~out


def text_rules(df: DataFrame, text: str, rules: Sequence[TextRule], keep: Sequence[str]) -> DataFrame:
    """Rows ``(keep.., rule, passed)`` on lower-cased, space-collapsed text; NULL text fails."""
    low = F.coalesce(normalised(F.col(text)), F.lit(""))
    tested = df.select(*keep, low.alias("_low"))
    verdicts = F.array(
        *[F.struct(F.lit(r.name).alias("rule"), r.passed(F.col("_low")).alias("passed")) for r in rules]
    )
    return tested.select(*keep, F.explode(verdicts).alias("_v")).select(*keep, "_v.rule", "_v.passed")


def text_rule_rows(texts: DataFrame, text_id: str, text: str, rules: DataFrame, *, broken_only: bool = False) -> DataFrame:
    """Rows ``(text_id, rule, passed)`` for rules that are rows themselves, as many as there are, in one plan.

    ``rules`` has ``rule, mode, kind, term``: a rule's rows share its mode (``require_all``, ``require_any`` or
    ``forbid``); kind is ``phrase`` or ``pattern``, of which patterns are tested on each text. All phrases of all rules
    are looked up together (:func:`seed_scan`); a text then meets the rules with its own few hits beside it, so that no
    row per text and rule is shuffled. Texts are lower-cased and space-collapsed, NULL has none of the terms; ids are
    distinct. ``broken_only`` leaves out what passed. A rule with another mode or kind, or with several modes, is refused.
    """
    known = F.col("mode").isin("require_all", "require_any", "forbid") & F.col("kind").isin("phrase", "pattern")
    odd = rules.where(~F.coalesce(known, F.lit(False)) | F.col("term").isNull() | (F.col("term") == "")).select("rule").union(
        rules.groupBy("rule").agg(F.count_distinct("mode").alias("n")).where("n > 1").select("rule")
    )
    fail_closed(odd.distinct(), "rules that cannot be read")
    spelled = F.when(F.col("kind") == "phrase", normalised(F.col("term"))).otherwise(F.col("term"))
    terms = cut(rules.select("rule", "mode", "kind", spelled.alias("term")).distinct(), "rule-terms")
    phrases = terms.where("kind = 'phrase'")
    hits = seed_scan(texts, text_id, text, phrases.select(F.col("term").alias("needle")).distinct())
    by_rule = hits.withColumnRenamed("needle", "term").join(phrases.select("rule", "term"), "term").groupBy(text_id, "rule").agg(F.count("*").alias("n"))
    own = by_rule.groupBy(text_id).agg(F.map_from_entries(F.collect_list(F.struct("rule", "n"))).alias("_hits"))
    listed = terms.groupBy("rule", "mode").agg(
        F.count("*").alias("n"), F.collect_list(F.when(F.col("kind") == "pattern", F.col("term"))).alias("patterns")
    )
    # the rules are one value that every text meets: rows of a rule table, not rows of data
    all_rules = listed.agg(F.collect_list(F.struct("rule", "mode", "n", "patterns"))).scalar()
    low = F.coalesce(normalised(F.col(text)), F.lit(""))
    judged = texts.select(text_id, low.alias("_low")).join(own, text_id, "left").withColumn("_rules", all_rules)

    def verdict(r: Column) -> Column:
        found = F.coalesce(F.element_at("_hits", r["rule"]), F.lit(0)) + F.size(F.filter(r["patterns"], lambda p: F.regexp_like(F.col("_low"), p)))
        passed = F.when(r["mode"] == "require_all", found == r["n"]).when(r["mode"] == "require_any", found > 0).otherwise(found == 0)
        return F.struct(r["rule"].alias("rule"), passed.alias("passed"))

    verdicts = F.transform("_rules", verdict)
    if broken_only:
        verdicts = F.filter(verdicts, lambda v: ~v["passed"])
    return judged.select(text_id, F.explode(verdicts).alias("_v")).select(text_id, "_v.rule", "_v.passed")


def policy_rows(
    subjects: DataFrame, policies: DataFrame, scope: Sequence[str], *, subject: str, value: str
) -> DataFrame:
    """Policies held as rows, joined to their subjects on the scope columns.

    A policy has ``policy, rule, argument``: ``matches`` (pattern), ``contains``, ``equals``,
    ``at_least`` and ``at_most`` (numbers). An unknown rule is a failed row, not an error.
    """
    joined = subjects.join(policies, list(scope))
    text = F.col(value).cast("string")
    number, bound = text.try_cast("double"), F.col("argument").try_cast("double")
    passed = (
        F.when(F.col("rule") == "matches", F.regexp_like(text, F.col("argument")))
        .when(F.col("rule") == "contains", F.contains(text, F.col("argument")))
        .when(F.col("rule") == "equals", text == F.col("argument"))
        .when(F.col("rule") == "at_least", number >= bound)
        .when(F.col("rule") == "at_most", number <= bound)
    )
    known = F.col("rule").isin("matches", "contains", "equals", "at_least", "at_most")
    message = F.when(~known, F.concat(F.lit("unknown rule "), F.col("rule")))
    return joined.select(
        *scope, subject, "policy", F.coalesce(passed, F.lit(False)).alias("passed"), message.alias("message")
    )


def has_number(text: Column, number: str) -> Column:
    """Whether the digits occur and are not part of a longer number."""
    return text.rlike(rf"(?<!\d){number}(?!\d)")


def has_version(text: Column, version: str) -> Column:
    """Whether the version occurs and is not part of a longer version."""
    quoted = version.replace(".", r"\.")
    return text.rlike(rf"(?<![\d.]){quoted}(?!\d)(?!\.\d)")


# Words that excuse what follows them.
NEGATIONS = r"\b(?:never|not|don'?t|doesn'?t|won'?t|wouldn'?t|avoid|without|rather than|instead of)\b"
FENCE = r"(?m)^\s*```"


def forbidden_mentions(
    df: DataFrame,
    text: str,
    pattern: str,
    keep: Sequence[str],
    *,
    negations: str = NEGATIONS,
    within_chars: int = 200,
    within_words: int | None = None,
) -> DataFrame:
    """Matches of a forbidden pattern with their position, and whether a negation excuses them.

    A negation excuses in the preceding ``within_chars`` characters, or, when ``within_words`` is
    given, only with at most that many words between it and the match. Inside a code fence (an odd
    number of line-start fences before the match) nothing excuses. Positions come from the pieces
    between matches, so neighbouring matches may share their context.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(1))
    pieces = F.split(F.col(text), pattern, -1)
    lengths = F.transform(
        F.arrays_zip(pieces.alias("p"), found.alias("m")),
        lambda x: F.struct(
            F.length(x["p"]).alias("before"), F.coalesce(F.length(x["m"]), F.lit(0)).alias("size")
        ),
    )
    places = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, x: F.struct(
            (acc["at"] + x["before"] + x["size"]).alias("at"),
            F.when(
                x["size"] > 0, F.array_append(acc["starts"], acc["at"] + x["before"])
            ).otherwise(acc["starts"]).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )
    def judged(start: Column) -> Column:
        before = F.substring(
            F.col(text), F.greatest(start - within_chars, F.lit(0)) + 1, F.least(start, F.lit(within_chars))
        )
        tail = "" if within_words is None else rf"(?:\s+\S+){{0,{within_words}}}\s+\z"
        fences = F.regexp_count(F.substring(F.col(text), F.lit(1), start), F.lit(FENCE))
        fenced = F.when(F.contains(F.col(text), F.lit("```")), F.pmod(fences, F.lit(2)) == 1).otherwise(F.lit(False))
        excused = before.rlike(f"(?i){negations}{tail}") & ~fenced
        return F.struct(start.cast("bigint").alias("position"), excused.alias("excused"))

    # every match is judged inside its row: texts are never repeated per match
    hits = df.where(F.col(text).rlike(pattern)).select(*keep, F.explode(F.transform(places, judged)).alias("_h"))
    return hits.select(*keep, "_h.position", "_h.excused")


def sections(df: DataFrame, text: str, heading: str, keep: Sequence[str]) -> DataFrame:
    """The parts of a text from one heading to the next; the part before the first has number 0."""
    parts = F.split(F.col(text), f"(?={heading})", -1)
    opening = ~F.get(parts, F.lit(0)).rlike(rf"\A(?:{heading})")
    numbered = df.select(*keep, opening.alias("_o"), F.posexplode(parts).alias("_p", "body"))
    return numbered.select(
        *keep,
        (F.col("_p") + F.when(F.col("_o"), 0).otherwise(1)).cast("bigint").alias("section"),
        "body",
    ).where(~((F.col("section") == 0) & (F.col("body") == "")))


def section_rule(
    parts: DataFrame, keep: Sequence[str], required: str, *, max_sections: int = 0
) -> DataFrame:
    """Per document its sections, those lacking the required pattern, and the verdict.

    No section at all fails; ``max_sections`` (0 = none) caps how many there may be.
    """
    lacking = ~F.col("body").rlike(required)
    counts = parts.groupBy(*keep).agg(
        F.count_if(F.col("section") > 0).alias("n_sections"),
        F.count_if((F.col("section") > 0) & lacking).alias("n_lacking"),
    )
    ok = (F.col("n_sections") > 0) & (F.col("n_lacking") == 0)
    if max_sections:
        ok = ok & (F.col("n_sections") <= max_sections)
    return counts.withColumn("passed", ok)


def occurs_before(text: Column, first: str, second: str) -> Column:
    """Whether ``first`` occurs, and before any ``second``."""
    a, b = F.regexp_instr(text, F.lit(first)), F.regexp_instr(text, F.lit(second))
    return (a > 0) & ((b == 0) | (a < b))


def near_each_other(text: Column, left: Sequence[str], right: Sequence[str], gap: int) -> Column:
    """Whether any left and any right phrase stand within ``gap`` characters of one line."""
    a, b = "|".join(left), "|".join(right)
    return text.rlike(rf"(?i)(?:(?:{a}).{{0,{gap}}}(?:{b}))|(?:(?:{b}).{{0,{gap}}}(?:{a}))")


@dataclass(frozen=True)
class KindSpec:
    """A class of a keyword classifier: its name, its title tag and the term that names it."""

    name: str
    tag: str
    term: str


# Words that take back the class named right after them.
CLASS_NEGATIONS = ("not", "isn't", "isnt", "never", "rather than", "as opposed to", "instead of")


def classify(text: Column, kinds: Sequence[KindSpec], negations: Sequence[str] = CLASS_NEGATIONS) -> Column:
    """A struct ``stated, tag, status`` for a text that names one of several classes.

    The title tag is cut from the prose first. One named class is stated; of several, exactly one
    must be left without a negation up to three words before it. ``status`` is ``ok``, ``unnamed``,
    ``untagged``, ``unresolved`` or ``tag_mismatch``.
    """
    tags = "|".join(k.tag.replace("(", r"\(").replace(")", r"\)") for k in sorted(kinds, key=lambda k: -len(k.tag)))
    lead = r"^[^\S\n]*(?:#{1,6}[^\S\n]*)?(?:\*\*)?"
    low = F.lower(text)
    tag = F.regexp_extract(low, rf"(?m){lead}({tags}):[^\S\n]*\S", 1)
    prose = F.regexp_replace(low, rf"(?m){lead}(?:{tags}):[^\S\n]*", " ")
    words = "|".join(negations)

    def named(k: KindSpec) -> Column:
        return prose.rlike(rf"\b{k.term}\b")

    def denied(k: KindSpec) -> Column:
        return prose.rlike(rf"(?:{words})\b(?:\s+\w+){{0,3}}\s+{k.term}\b")

    all_named = F.array_compact(F.array(*[F.when(named(k), F.lit(k.name)) for k in kinds]))
    upheld = F.array_compact(F.array(*[F.when(named(k) & ~denied(k), F.lit(k.name)) for k in kinds]))
    left = F.when(F.size(all_named) == 1, all_named).otherwise(upheld)
    stated = F.when(F.size(left) == 1, F.get(left, F.lit(0)))
    wanted = F.lit(None).cast("string")
    for k in kinds:
        wanted = F.when(stated == k.name, F.lit(k.tag)).otherwise(wanted)
    status = (
        F.when(F.size(all_named) == 0, "unnamed")
        .when(tag == "", "untagged")
        .when(stated.isNull(), "unresolved")
        .when(tag != wanted, "tag_mismatch")
        .otherwise("ok")
    )
    return F.struct(stated.alias("stated"), tag.alias("tag"), status.alias("status"))


# Vocabulary that paths and hosts carry anyway and that identifies nobody.
GENERIC_TOKENS = (
    "users", "home", "local", "internal", "external", "infra", "corp", "admin", "system", "server",
    "client", "schema", "schemas", "yaml",
)
MIN_TOKEN = 5


def seed_needles(seeds: DataFrame, seed: str, *, stop: Sequence[str] = GENERIC_TOKENS) -> DataFrame:
    """What to look for: each whole normalised seed and every distinctive token of it."""
    tokens = F.filter(
        F.split(F.lower(F.col(seed)), "[^a-z0-9]+"),
        lambda x: (F.length(x) >= MIN_TOKEN) & ~x.isin(list(stop)),
    )
    whole = F.trim(normalised(F.col(seed)))
    return (
        seeds.select(F.explode(F.array_append(tokens, whole)).alias("needle"))
        .where(F.col("needle") != "")
        .distinct()
    )


#: What a text is cut into to look needles up: words, and each other character by itself.
WORD_BREAK = r"[^\p{L}\p{N}]+"


def seed_scan(texts: DataFrame, text_id: str, text: str, needles: DataFrame) -> DataFrame:
    """Every ``(text_id, needle)`` where the normalised text contains the needle.

    A run of letters and digits inside a needle lies inside one word of the text. So each needle is looked up by its
    longest run, or its first character if it has none: first among the distinct words and other characters of the
    corpus, by the first characters of the run, then through the texts' own lists of them. A needle that is one run is
    thereby found; the others' candidates are gathered by text and compared with it in full, once per text.
    """
    low = texts.select(text_id, normalised(F.col(text)).alias("_low"))
    words = F.filter(F.split("_low", WORD_BREAK), lambda x: x != "")
    # all but letters, digits and blanks, one by one, and a blank
    blank = F.when(F.contains("_low", F.lit(" ")), F.array(F.lit(" "))).otherwise(F.array().cast("array<string>"))
    marks = F.concat(blank, F.regexp_extract_all(F.regexp_replace("_low", r"[\p{L}\p{N} ]+", ""), F.lit("(?s)(.)"), F.lit(1)))
    units = cut(low.select(text_id, F.array_distinct(F.concat(words, marks)).alias("_units")), "units")
    runs = F.filter(F.split("needle", WORD_BREAK), lambda x: x != "")
    longest = F.array_max(F.transform(runs, lambda x: F.struct(F.length(x).alias("n"), x.alias("run"))))
    anchored = needles.where(F.col("needle") != "").select("needle", F.coalesce(longest["run"], F.left("needle", F.lit(1))).alias("run")).distinct()
    opening = anchored.select("run", F.left("run", F.lit(MIN_TOKEN)).alias("gram")).distinct()
    grams = F.flatten(F.array(*[_grams("unit", n) for n in range(1, MIN_TOKEN + 1)]))
    inside = (
        units.select(F.explode("_units").alias("unit")).distinct()
        .select("unit", F.explode(grams).alias("gram"))
        .join(opening, "gram")
        .where(F.contains("unit", "run"))
        .select("unit", "run")
    )
    met = units.select(text_id, F.explode("_units").alias("unit")).join(inside, "unit").select(text_id, "run").distinct()
    hits = cut(met.join(anchored, "run"), "hits")  # read twice below
    alone = F.col("needle") == F.col("run")
    gathered = hits.where(~alone).groupBy(text_id).agg(F.collect_set("needle").alias("_needles"))
    whole = gathered.join(low, text_id).select(
        text_id, F.explode(F.filter("_needles", lambda x: F.contains(F.col("_low"), x))).alias("needle")
    )
    return hits.where(alone).select(text_id, "needle").unionByName(whole)


def _grams(column: str, size: int) -> Column:
    """The distinct substrings of a length; a look-ahead matches at every position in one pass."""
    return F.array_distinct(F.regexp_extract_all(column, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def distinct_tokens(
    df: DataFrame, row_id: str, text: str, min_length: int, stop: Sequence[str] = ()
) -> DataFrame:
    """Rows ``(row_id, token)`` of the distinct ASCII word tokens of a text, without stop words."""
    tokens = F.array_distinct(F.split(F.lower(F.col(text)), "[^a-z0-9]+"))
    if stop:
        tokens = F.array_except(tokens, F.array(*[F.lit(w) for w in sorted(set(stop))]))
    long = F.filter(tokens, lambda x: F.length(x) >= min_length)
    return df.select(row_id, F.explode(long).alias("token"))


def known_issue_scores(
    subjects: DataFrame, issues: DataFrame, *, subject: str, subject_text: str, issue: str,
    issue_text: str, min_length: int = 1, stop: Sequence[str] = (), synonyms: DataFrame | None = None,
) -> DataFrame:
    """Shared-token score of subjects and known issues, open and closed alike.

    A token weighs 10**9 // (issues that hold it), 1 at least, so constant words of one issue count most
    and no shared token is lost. ``stop`` and ``min_length`` leave out what the caller holds to say
    nothing. Scores are summed map-side; with ``synonyms`` (``token, synonym``) a second pass adds the
    synonyms of the subject's tokens.
    """
    words = distinct_tokens(subjects, subject, subject_text, min_length, stop)
    if synonyms is not None:
        also = words.join(synonyms, "token").select(subject, F.col("synonym").alias("token"))
        words = words.unionByName(also).distinct()
    index = distinct_tokens(issues, issue, issue_text, min_length, stop)
    weights = index.groupBy("token").agg(F.expr("greatest(1, 1000000000 div count(*))").alias("weight"))
    weighted = index.join(weights, "token")
    return (
        words.join(weighted, "token")
        .groupBy(subject, issue)
        .agg(F.count("*").alias("n_shared"), F.sum("weight").cast("bigint").alias("score"))
    )


def top_known_issues(
    subjects: DataFrame, issues: DataFrame, k: int, *, subject: str, subject_text: str, issue: str, issue_text: str,
    min_score: int = 1, stop: Sequence[str] = (), rare: int = 128, widen: int = 16,
) -> DataFrame:
    """The ``k`` best known issues of each subject, as :func:`known_issue_scores` scores them, without all pairs.

    Ties go to the smaller issue; issues below ``min_score`` do not count. Subjects with the same known words are scored
    once. A round lets subjects meet issues on words of at most ``rare`` issues only. All other words of a subject
    together bound what an issue it did not meet could score, and what one it met could still gain: where that is
    below the k-th score so far, the subject is settled, and only issues that can still pass are scored in full. The
    rest go on with ``widen`` times the bound, so that a frequent word is joined for those subjects alone whose
    answer may hang on it.
    """
    words = distinct_tokens(subjects, subject, subject_text, 1, stop)
    index = cut(distinct_tokens(issues, issue, issue_text, 1, stop), "issue-words")
    weights = cut(
        index.groupBy("token").agg(F.count("*").alias("df")).withColumn("weight", F.expr("greatest(1, 1000000000 div df)")), "weights"
    )
    known = cut(words.join(weights, "token").withColumn("token", F.xxhash64("token")), "subject-words")
    posted = cut(index.join(weights, "token").withColumn("token", F.xxhash64("token")), "postings")
    # equal sets of words are one subject
    marks = [F.bit_xor(F.xxhash64("token", F.lit(m))).alias(f"_m{m}") for m in (1, 2)]
    sets = cut(known.groupBy(subject).agg(*marks, F.count("*").alias("_n")), "word-sets")
    same = ["_m1", "_m2", "_n"]
    firsts = sets.groupBy(*same).agg(F.min(subject).alias("_rep"))
    todo = cut(firsts.select(F.col("_rep").alias(subject)), "subjects")
    most = weights.agg(F.max("df")).first()[0] or 0
    found = None
    pair = F.struct("token", "weight")
    while True:
        own = known.join(todo, subject, "left_semi")
        near = (
            own.where(F.col("df") <= rare).select(subject, "token", "weight")
            .join(posted.where(F.col("df") <= rare).select(issue, "token"), "token")
            .groupBy(subject, issue).agg(F.sum("weight").alias("_s"), F.count("*").alias("_c"))
        )
        near = cut(near, "met")
        hot = own.where(F.col("df") > rare).groupBy(subject).agg(F.sum("weight").alias("_more"), F.collect_list(pair).alias("_hot"))
        best = Window.partitionBy(subject).orderBy(F.col("_s").desc())
        kth = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).groupBy(subject).agg(
            F.max("_r").alias("_r"), F.min("_s").alias("_kth")
        )
        bar = F.greatest(F.when(F.col("_r") == k, F.col("_kth")).otherwise(0), F.lit(min_score))
        bounds = cut(
            todo.join(hot, subject, "left").join(kth, subject, "left")
            .select(subject, F.coalesce("_more", F.lit(0)).alias("_more"), "_hot", F.coalesce(bar, F.lit(min_score)).alias("_bar")),
            "bounds",
        )
        settled = bounds.where(F.col("_more") < F.col("_bar"))
        issue_hot = posted.where(F.col("df") > rare).groupBy(issue).agg(F.collect_list(pair).alias("_theirs"))
        none = F.array().cast("array<struct<token:bigint,weight:bigint>>")
        scored = (
            near.join(settled, subject).where(F.col("_s") + F.col("_more") >= F.col("_bar")).join(issue_hot, issue, "left")
            .withColumn("_both", F.array_intersect(F.coalesce("_hot", none), F.coalesce("_theirs", none)))
            .select(
                subject, issue, (F.col("_c") + F.size("_both")).cast("bigint").alias("n_shared"),
                (F.col("_s") + F.aggregate("_both", F.lit(0).cast("bigint"), lambda n, x: n + x["weight"])).cast("bigint").alias("score"),
            )
        )
        place = Window.partitionBy(subject).orderBy(F.col("score").desc(), issue)
        top = cut(
            scored.where(F.col("score") >= min_score).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k), "top"
        )
        found = top if found is None else found.unionByName(top)
        if rare >= most:
            break
        todo = cut(bounds.where(F.col("_more") >= F.col("_bar")).select(subject), "subjects")
        if todo.isEmpty():
            break
        rare *= widen
    reps = sets.join(firsts, same).select(subject, "_rep")
    return reps.join(found.withColumnRenamed(subject, "_rep"), "_rep").select(subject, issue, "n_shared", "score", "rank")


#: How many keys a shape may have for partners of one size.
KEYS_OF_A_SHAPE = 64


def _combinations(codes: Column, k: Column) -> Column:
    """A number for each combination of ``k`` of the codes, the same in whatever array the codes stand.

    To leave out none or one code is read off the number of all codes. Else, code by code, each combination begun so
    far goes on with the code and without it; one that the codes left cannot fill any more is dropped.
    """
    whole = F.aggregate(codes, F.lit(0).cast("bigint"), lambda key, x: key.bitwiseXOR(x))
    left = F.size(codes)
    placed = F.transform(codes, lambda x, i: F.struct(x.alias("code"), (left - i - 1).alias("left")))
    none = F.array(F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("key")))

    def taken(begun: Column, x: Column) -> Column:
        more = F.transform(
            F.filter(begun, lambda c: c["n"] < k),
            lambda c: F.struct((c["n"] + 1).alias("n"), c["key"].bitwiseXOR(x["code"]).alias("key")),
        )
        return F.filter(F.concat(begun, more), lambda c: c["n"] + x["left"] >= k)

    return (
        F.when(left == k, F.array(whole))
        .when(left == k + 1, F.zip_with(codes, F.array_repeat(whole, left), lambda x, all_of: all_of.bitwiseXOR(x)))
        .otherwise(F.transform(F.aggregate(placed, none, taken), lambda c: c["key"]))
    )


def shape_duplicates(
    members: DataFrame, node: str, attribute: str, *, percent: int = 70, min_nodes: int = 3
) -> DataFrame:
    """Shapes (sets of attributes) with at least ``min_nodes`` nodes of like shape around them.

    Alike means a Jaccard overlap above ``percent`` (50 at least). Nodes of equal shape are folded
    into one row first, so a group of copies never meets itself. Different shapes meet by the pair of their sizes, which
    says how many attributes ``t`` two alike must share. Two that share ``t`` share at least ``k`` of their
    ``size - t + k`` rarest ones, so they meet on a combination of ``k`` of these instead of one attribute that most
    shapes may have: on ``t`` at once where that makes at most ``KEYS_OF_A_SHAPE`` combinations, as it does for small
    shapes, else on as many as keep to it. Only sizes that occur are paired. The bits of their attributes that differ
    leave out pairs that cannot share ``t``. Every other candidate is verified on all attributes.
    """
    if percent < 50:
        raise ValueError("below 50 percent a single shared attribute could be enough")
    # what several steps below read is written once instead of being derived again for each
    pairs = cut(members.select(node, attribute).distinct(), "pairs")
    code = F.xxhash64(attribute)
    mark = F.xxhash64(F.lit("second"), F.col(attribute))
    place = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(F.lit("bit"), F.col(attribute)), F.lit(64)).cast("int"))
    shapes = (
        pairs.groupBy(node)
        .agg(F.count("*").alias("n"), F.bit_xor(code).alias("_x"), F.bit_xor(mark).alias("_y"), F.bit_or(place).alias("bits"))
        .groupBy("n", "_x", "_y")
        .agg(F.min(node).alias("shape"), F.count("*").alias("n_nodes"), F.min("bits").alias("bits"))
        .select("shape", "n", "n_nodes", "bits")
    )
    shapes = cut(shapes, "shapes")
    held = cut(
        pairs.join(shapes.select(F.col("shape").alias(node), "n", "bits"), node).select(
            F.col(node).alias("shape"), "n", "bits", F.col(attribute).alias("attr")
        ),
        "held",
    )
    frequency = held.groupBy("attr").agg(F.count("*").alias("freq"))
    rarest = F.transform(F.array_sort(F.collect_list(F.struct("freq", F.xxhash64("attr").alias("code")))), lambda x: x["code"])
    # two of sizes n and m alike share more than percent (n + m) / (100 + percent) attributes
    least = lambda total: F.floor(total * percent / (100 + percent)) + 1
    listed = cut(held.join(frequency, "attr").groupBy("shape", "n", "bits").agg(rarest.alias("codes")), "rarest")
    sizes = shapes.agg(F.array_sort(F.collect_set("n"))).scalar()
    own, other = F.col("n"), F.col("m")
    enough = F.least(own, other) * 100 > F.greatest(own, other) * percent
    # two different shapes of one size do not share all attributes
    apart = (own != other) | (least(own + other) < own)
    # the most attributes a key may have, by how many the larger one may lack
    spare = F.greatest(own, other) - F.col("t")
    widest = F.array(*[F.lit(max(k for k in range(1, KEYS_OF_A_SHAPE) if comb(d + k, k) <= KEYS_OF_A_SHAPE)) for d in range(1, KEYS_OF_A_SHAPE)])
    paired = (
        listed.withColumn("_sizes", sizes).withColumn("m", F.explode("_sizes"))
        .where(enough & apart)
        .withColumn("t", least(own + other))
        .withColumn("k", F.least(F.col("t").cast("int"), F.coalesce(F.get(widest, (spare - 1).cast("int")), F.lit(1))))
        .select("shape", "n", "m", "bits", F.explode(_combinations(F.slice("codes", F.lit(1), (own - F.col("t") + F.col("k")).cast("int")), F.col("k"))).alias("key"))
    )

    def side(end: str, fits: Column) -> DataFrame:
        """Rows of shapes that meet partners of another size, for the keys they may meet on."""
        low, high = ("n", "m") if end == "a" else ("m", "n")
        return paired.where(fits).select("key", F.col(low).alias("na"), F.col(high).alias("nb"), F.col("shape").alias(end), F.col("bits").alias(f"bits_{end}"))

    smaller, larger = side("a", own <= other), side("b", other <= own)
    differing = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b")))
    possible = (
        ((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b")))
        & (differing <= F.col("na") + F.col("nb") - 2 * least(F.col("na") + F.col("nb")))
    )
    candidates = cut(smaller.join(larger, ["key", "na", "nb"]).where(possible).select("a", "b", "na", "nb").distinct(), "candidates")
    shared = cut(
        candidates.join(held.select(F.col("shape").alias("a"), "attr"), "a")
        .join(held.select(F.col("shape").alias("b"), "attr"), ["b", "attr"])
        .groupBy("a", "b", "na", "nb")
        .agg(F.count("*").alias("o"))
        .where(F.col("o") * 100 > (F.col("na") + F.col("nb") - F.col("o")) * percent),
        "alike",
    )
    both = shared.select(F.col("a").alias("shape"), F.col("b").alias("other")).unionByName(
        shared.select(F.col("b").alias("shape"), F.col("a").alias("other"))
    )
    around = both.join(
        shapes.select(F.col("shape").alias("other"), F.col("n_nodes").alias("m")), "other"
    ).groupBy("shape").agg(F.sum("m").alias("m"))
    total = F.col("n_nodes") + F.coalesce("m", F.lit(0))
    return shapes.join(around, "shape", "left").select(
        "shape", F.col("n").alias("n_attributes"), "n_nodes", total.alias("n_alike")
    ).where(F.col("n_alike") >= min_nodes)
