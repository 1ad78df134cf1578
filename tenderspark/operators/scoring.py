"""Compatibility scores of (contractor, notice) pairs on seven factors.

Every factor is a function from pairs to (contractor_id, notice_id, score,
is_null, reason ...).  Pairs come from `feed.candidate_pairs`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderspark.fixed import AGENCY_STOPWORDS, KEYWORD_STOPWORDS, PLACE_STOPWORDS
from tenderspark.functions.common import drop_blank, let, literals, round_half_up, strip, tokens
from tenderspark.operators.departments import lookup_department
from tenderspark.operators.ranking import top_per_key
from tenderspark.session import stage

PAIR = ["contractor_id", "notice_id"]
FACTORS = ("timing", "experience", "goals", "prereqs", "geography", "agency", "keywords")
MODEL_VERSION = "compat-v2"
SHOWN = 5  # past projects a judge is shown
CROWD = 10_000  # pairs from which the notice is joined apart
DETAILS = {"experience": ("matched_past_projects",), "prereqs": ("met", "unmet", "total"), "agency": ("matched_clients",), "keywords": ("matched_terms",)}
# Fixed: wording of the reasons for codes, by how well they match.
CODE_REASONS = (("exact", "Matches NAICS "), ("industry-group", "Adjacent NAICS match (4-digit) for "),
                ("sector", "Only broad sector overlap on NAICS "), ("none", "Missing NAICS "))
WILDCARDS = ("federal", "nationwide", "any", "*")


# --- whole-word terms -------------------------------------------------------------

def notice_text(notices: DataFrame) -> DataFrame:
    """(notice_id, text): lower-case title, description and tags."""
    return notices.select("notice_id", F.lower(F.concat_ws(
        " ", "title", F.coalesce("description", F.lit("")), F.array_join("tags", " "))).alias("text"))


def _runs(text: Column) -> tuple[Column, Column]:
    """The runs of letters and digits of a lower-case text, and what stands before the first, between them and after the last."""
    return F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)), F.split(text, "[a-z0-9]+", -1)


def term_parts(terms: DataFrame) -> DataFrame:
    """(term, m, k, run, t_before, t_after): the `m` runs of each distinct term, with the term's characters around each."""
    runs, gaps = _runs(F.col("term"))
    cut = terms.select("term").distinct().select("term", runs.alias("_r"), gaps.alias("_g"))
    return cut.select("term", F.size("_r").alias("m"), "_g", F.posexplode("_r").alias("k", "run")) \
        .select("term", "m", "k", "run", F.element_at("_g", F.col("k") + 1).alias("t_before"), F.element_at("_g", F.col("k") + 2).alias("t_after"))


def postings(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(notice_id, pos, n, run, before, after): where in the `n` runs of a text runs of any term stand, and what stands around them.

    Of the characters beside a run as many are kept as any term has there, and one
    more.  Other runs go where the texts lie: with a vocabulary that Spark may
    broadcast nothing of a text is shuffled, and never more than its runs.
    """
    vocabulary = parts.groupBy("run").agg((F.max(F.greatest(F.length("t_before"), F.length("t_after"))) + 1).alias("_near"))
    runs, gaps = _runs(F.col("text"))
    cut = texts.select("notice_id", runs.alias("_r"), gaps.alias("_g"))
    shown = cut.select("notice_id", F.size("_r").alias("n"), F.posexplode(F.arrays_zip(
        "_r", F.slice("_g", F.lit(1), F.size("_r")).alias("_b"), F.slice("_g", F.lit(2), F.size("_r")).alias("_a"))).alias("pos", "_x"))
    run, before, after = (F.col("_x").getField(c) for c in ("_r", "_b", "_a"))
    near = F.col("_near")
    return shown.select("notice_id", "pos", "n", run.alias("run"), before.alias("before"), after.alias("after")).join(vocabulary, "run").select(
        "notice_id", "pos", "n", "run", F.right("before", near).alias("before"), F.left("after", near).alias("after"))


def _fits() -> Column:
    """Whether what stands around a run in a text is what stands around it in a term: outside the term comes an end or a character that is no letter or digit."""
    left = F.when(F.col("k") > 0, F.col("before") == F.col("t_before")).otherwise(
        (F.col("t_before") == "") | (F.endswith("before", "t_before") & ((F.length("before") > F.length("t_before")) | (F.col("pos") == 0))))
    right = F.when(F.col("k") < F.col("m") - 1, F.col("after") == F.col("t_after")).otherwise(
        (F.col("t_after") == "") | (F.startswith("after", "t_after") & ((F.length("after") > F.length("t_after")) | (F.col("pos") == F.col("n") - 1))))
    return left & right


def _bare_hits(texts: DataFrame, bare: DataFrame) -> DataFrame:
    """(notice_id, term) for terms without letters or digits: looked for in what stands between the runs, by their first character."""
    gaps = F.split(F.col("text"), "[a-z0-9]+", -1)
    shown = texts.select("notice_id", F.size(gaps).alias("n"), F.posexplode(gaps).alias("pos", "gap")).filter(F.trim("gap") != "")
    # A letter stands for the run that a gap begins or ends at.
    edge = lambda inner: F.when(inner, F.lit("a")).otherwise("")
    shown = shown.select("notice_id", F.concat(edge(F.col("pos") > 0), "gap", edge(F.col("pos") < F.col("n") - 1)).alias("gap"),
                         F.explode(F.array_distinct(F.split("gap", ""))).alias("_c"))
    met = shown.join(bare.select("term", F.left("term", F.lit(1)).alias("_c")), "_c")
    quoted = F.regexp_replace("term", r"([^a-z0-9 ])", r"\\$1")
    edges = F.lit("[^a-z0-9]")
    return met.filter(F.rlike("gap", F.concat(F.lit("(?:^|"), edges, F.lit(")"), quoted, F.lit("(?:$|"), edges, F.lit(")")))).select("notice_id", "term")


def term_hits(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(notice_id, term): terms that stand in a text as whole words.

    An inverted index of the runs that terms consist of, with their places.  A term
    of one run is found in it at once; a longer one is looked for from its rarest
    run, and its other runs must stand at the places around it with the term's
    characters between them.  The parts of the terms and the index are staged: the
    parts so that Spark knows their size, the index as it is read again.
    """
    parts = stage(term_parts(terms), "term-parts")
    index = stage(postings(texts, parts), "term-postings")
    single = index.join(parts.filter("m = 1"), "run").filter(_fits()).select("notice_id", "term")
    often = index.groupBy("run").agg(F.count(F.lit(1)).alias("_n"))
    longer = parts.filter("m > 1").join(often, "run", "left")
    rarest = longer.groupBy("term").agg(F.min_by("k", F.struct(F.coalesce("_n", F.lit(0)), "k")).alias("_rare"))
    longer = longer.drop("_n").join(rarest, "term")
    starts = index.join(longer.filter("k = _rare"), "run").filter(_fits()).select("notice_id", "term", (F.col("pos") - F.col("k")).alias("start"))
    wanted = starts.join(longer.filter("k <> _rare").drop("_rare"), "term").withColumn("pos", F.col("start") + F.col("k"))
    together = wanted.join(index, ["notice_id", "pos", "run"]).filter(_fits()).groupBy("notice_id", "term", "start", "m").agg(F.count(F.lit(1)).alias("_found")) \
        .filter("_found = m - 1").select("notice_id", "term")
    hits = single.unionByName(together)
    bare = terms.select("term").distinct().filter(~F.rlike("term", F.lit("[a-z0-9]")))
    if not bare.isEmpty():
        hits = hits.unionByName(_bare_hits(texts, bare))
    return hits.distinct()


def by_lot(df: DataFrame) -> DataFrame:
    """The rows of a contractor together, so that tables of pairs which are so laid out meet without a shuffle.

    Spark asks for partitions by all keys of a join unless the setting is off; it
    stays off in the session, as Spark reads it only when the plan runs.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df.repartition(int(conf.get("spark.sql.shuffle.partitions")), "contractor_id")


def join_sides(pairs: DataFrame, by_contractor: DataFrame, by_notice: DataFrame, how: str = "inner") -> DataFrame:
    """Pairs with the columns of their contractor and of their notice.

    Notices at the head of the feed stand in a pair of nearly every contractor.
    Those in more than `CROWD` pairs are staged, so that Spark knows how few they
    are and broadcasts them: their pairs are shuffled once, by contractor, while
    they are still two keys.  The pairs of a contractor stay together (`by_lot`).
    """
    crowded = stage(pairs.groupBy("notice_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CROWD).select("notice_id"), "crowded")
    few = stage(by_notice.join(crowded, "notice_id", "left_semi"), "crowded-notices")

    with_contractor = lambda df: by_lot(df).join(by_lot(by_contractor), "contractor_id", how)
    met = with_contractor(pairs.join(crowded, "notice_id", "left_semi")).join(few, "notice_id", how)
    return met.unionByName(with_contractor(pairs.join(crowded, "notice_id", "left_anti").join(by_notice, "notice_id", how)))


def _terms_found(hits: DataFrame) -> DataFrame:
    """(notice_id, _hits): the terms that each notice names, staged as they are read more than once."""
    return stage(hits.groupBy("notice_id").agg(F.collect_set("term").alias("_hits")), "terms-found")


def exclusions(pairs: DataFrame, contractors: DataFrame, notices: DataFrame) -> DataFrame:
    """Adds excluded and term: the first no-go term of the contractor that the notice names."""
    terms = contractors.select("contractor_id", F.posexplode(F.transform("exclusions", lambda x: F.lower(strip(x)))).alias("pos", "term")) \
        .filter(F.length("term") > 1)
    wanted = notices.join(pairs.select("notice_id").distinct(), "notice_id", "left_semi")
    hits = _terms_found(term_hits(notice_text(wanted), terms))
    own = terms.groupBy("contractor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("_terms"))
    found = join_sides(pairs.select(*PAIR), own, hits, "left").select(*PAIR, F.try_element_at(F.array_intersect("_terms", "_hits"), F.lit(1)).alias("term"))
    return found.select(
        *PAIR, F.col("term").isNotNull().alias("excluded"), "term",
        F.when(F.col("term").isNotNull(), F.concat(F.lit('Excluded: RFP mentions "'), "term", F.lit('" which is on the contractor\'s no-go list.'))).alias("reason"))


# --- deterministic factors -----------------------------------------------------------

def timing(pairs: DataFrame, as_of: str) -> DataFrame:
    """1 when the days left reach the preferred window, else 0; uses due_date and preferred_response_window_days."""
    left = (F.unix_micros("due_date") - F.unix_micros(F.lit(as_of).cast("timestamp"))) / 86400e6
    window = F.col("preferred_response_window_days")
    null = F.col("due_date").isNull() | window.isNull()
    ok = left >= window
    text = F.concat(F.lit("Due in "), F.format_string("%.1f", left), F.when(ok, F.lit(" days; meets the ")).otherwise(F.lit(" days; below the ")),
                    window.cast("string"), F.lit("-day response window."))
    return pairs.select(*PAIR, F.when(null, 0).otherwise(ok.cast("int")).alias("score"), null.alias("is_null"),
                        F.when(null, F.lit("Skipped: contractor has no preferred response window or RFP has no due date.")).otherwise(text).alias("reason"))


def geography_score(preferred: Column, state: Column, location: Column) -> Column:
    """struct(score, is_null, reason): preferred places against the notice's state and location."""
    prefs = drop_blank(F.transform(preferred, lambda p: F.lower(strip(p))))
    fields = drop_blank(F.transform(F.filter(F.array(state, location), lambda x: x.isNotNull()), lambda x: F.lower(strip(x))))

    def rate(both: Column) -> Column:
        ps, fs = both["p"], both["f"]
        place = F.array_join(fs, " | ")

        def match(p: Column) -> Column:
            part = F.filter(fs, lambda f: F.contains(p, f) & (F.length(f) > 2))
            return (F.when(F.contains(place, p), F.concat(F.lit('Preferred location "'), p, F.lit('" matches RFP location.')))
                    .when(F.size(part) > 0, F.concat(F.lit('RFP location "'), F.try_element_at(part, F.lit(1)), F.lit('" is part of preferred area "'), p, F.lit('".'))))

        first = F.try_element_at(F.filter(F.transform(ps, match), lambda r: r.isNotNull()), F.lit(1))
        shared = F.array_intersect(tokens(F.array_join(ps, " "), 2, PLACE_STOPWORDS), tokens(F.array_join(fs, " "), 2, PLACE_STOPWORDS))
        null = (F.size(ps) == 0) | (F.size(fs) == 0)
        said = lambda score, is_null, reason: F.struct(F.lit(score).alias("score"), F.lit(is_null).alias("is_null"), reason.alias("reason"))
        return (F.when(null, said(0, True, F.lit("Skipped: contractor has no preferred locations or RFP has no state/location.")))
                .when(F.arrays_overlap(ps, literals(WILDCARDS)), said(100, False, F.lit("Contractor accepts federal / nationwide opportunities.")))
                .when(first.isNotNull(), said(100, False, first))
                .when(F.size(shared) > 0, said(60, False, F.concat(F.lit("Partial location overlap on: "), F.array_join(shared, ", "), F.lit("."))))
                .otherwise(said(0, False, F.concat(F.lit("RFP location ("), F.array_join(fs, " / "), F.lit(") not in contractor's preferred areas ("),
                                                   F.array_join(ps, ", "), F.lit(").")))))

    return let(F.struct(prefs.alias("p"), fields.alias("f")), rate)


def geography(pairs: DataFrame) -> DataFrame:
    """Uses preferred_locations, state and location; rated in the row."""
    rated = pairs.select(*PAIR, geography_score(F.col("preferred_locations"), F.col("state"), F.col("location")).alias("_g"))
    return rated.select(*PAIR, "_g.score", "_g.is_null", "_g.reason")


def contractor_terms(contractors: DataFrame, past: DataFrame) -> DataFrame:
    """(contractor_id, term, place): distinct tags of past work, industries and sub-industries without stop words, in that order."""
    given = contractors.select("contractor_id", F.posexplode(F.concat("industries", "sub_industries")).alias("i", "term")) \
        .select("contractor_id", "term", F.struct(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("project"), "i").alias("place"))
    worked = past.select("contractor_id", F.col("project_id").cast("long").alias("project"), F.posexplode("tags").alias("i", "term")) \
        .select("contractor_id", "term", F.struct(F.lit(0).alias("kind"), "project", "i").alias("place"))
    return given.unionByName(worked).select("contractor_id", F.lower(strip("term")).alias("term"), "place") \
        .filter((F.length("term") > 1) & ~F.array_contains(literals(KEYWORD_STOPWORDS), F.col("term"))).groupBy("contractor_id", "term").agg(F.min("place").alias("place"))


def keywords(pairs: DataFrame, contractors: DataFrame, past: DataFrame, notices: DataFrame) -> DataFrame:
    """Share of contractor terms found in the notice, times 250, at most 100; matched terms in the contractor's order."""
    terms = contractor_terms(contractors.join(pairs.select("contractor_id").distinct(), "contractor_id", "left_semi"),
                             past.join(pairs.select("contractor_id").distinct(), "contractor_id", "left_semi"))
    own = terms.groupBy("contractor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("_terms"))
    wanted = notices.join(pairs.select("notice_id").distinct(), "notice_id", "left_semi")
    hits = _terms_found(term_hits(notice_text(wanted), terms))
    # A pair that is given more than once counts its terms as often.
    given = pairs.select(*PAIR).repartition("contractor_id").groupBy(*PAIR).agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    both = let(F.array_intersect("_terms", "_hits"), lambda m: F.when(F.col("_copies") == 1, m).otherwise(F.flatten(F.transform(m, lambda x: F.array_repeat(x, F.col("_copies"))))))
    joined = join_sides(given, own, hits, "left").select(*PAIR, F.size("_terms").alias("_size"), F.col("_terms").isNull().alias("_none"), both.alias("matched_terms"),
                                                         F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy"))
    joined = joined.withColumn("_total", F.when(~F.col("_none"), F.col("_size")))
    null = F.col("_total").isNull()
    n = F.when(F.col("matched_terms").isNull(), 0).otherwise(F.size("matched_terms"))
    score = F.least(F.lit(100), round_half_up(n / F.col("_total") * 250)).cast("int")
    reason = (F.when(null, "Skipped: contractor has no tags / industries / sub-industries on file.")
              .when(n == 0, "No contractor industries or tags appear in this RFP.")
              .otherwise(F.concat(F.lit("Matched "), n.cast("string"), F.lit(" of "), F.col("_total").cast("string"), F.lit(" contractor terms in RFP text/tags."))))
    return joined.select(*PAIR, F.when(null, 0).otherwise(score).alias("score"), null.alias("is_null"), reason.alias("reason"),
                         F.coalesce("matched_terms", F.array().cast("array<string>")).alias("matched_terms"))


def agency_tier(dept: Column, client: Column) -> Column:
    """100 same agency, 70 one inside the other, 40 two shared significant words, else 0."""
    d, c = F.lower(dept), F.lower(client)
    inside = ((F.length(c) > 4) & F.contains(d, c)) | ((F.length(d) > 4) & F.contains(c, d))
    shared = F.size(F.array_intersect(tokens(dept, 2, AGENCY_STOPWORDS), tokens(client, 2, AGENCY_STOPWORDS)))
    return F.when(d == c, 100).when(inside, 70).when(shared >= 2, 40).otherwise(0)


def agency(pairs: DataFrame, past: DataFrame, aliases: DataFrame) -> DataFrame:
    """Past clients against the notice's department, both under their canonical names.

    Rated once per (contractor, department) and, below that, once per (department, client).
    """
    named = past.filter(strip(F.coalesce("client", F.lit(""))) != "").select("contractor_id", strip("client").alias("client")).distinct()
    clients = lookup_department(named, aliases, "client", "client_name")
    clients = by_lot(clients).groupBy("contractor_id").agg(F.array_sort(F.collect_set("client_name")).alias("_clients"))
    given = by_lot(pairs.select(*PAIR, "department"))
    depts = given.filter(strip(F.coalesce("department", F.lit(""))) != "").select("contractor_id", "department").distinct()
    # Names are few: staged, so that Spark knows it.
    dept_names = stage(lookup_department(pairs.filter(strip(F.coalesce("department", F.lit(""))) != "").select("department").distinct(), aliases, "department", "dept_name"), "dept-names")
    met = depts.join(dept_names, "department").join(clients, "contractor_id")
    rated = met.select("dept_name", F.explode("_clients").alias("client_name")).distinct().withColumn("tier", agency_tier(F.col("dept_name"), F.col("client_name")))
    near = stage(rated.filter("tier > 0").groupBy("dept_name").agg(F.map_from_entries(F.collect_list(F.struct("client_name", "tier"))).alias("_tiers")), "client-tiers")
    tier_of = lambda c: F.coalesce(F.try_element_at("_tiers", c), F.lit(0))
    best = met.join(near, "dept_name", "left").select("contractor_id", "department", let(F.array_max(F.transform("_clients", tier_of)), lambda top: F.struct(
        top.alias("tier"), F.filter("_clients", lambda c: tier_of(c) == top).alias("names"))).alias("_b"))
    joined = given.join(best, ["contractor_id", "department"], "left")
    null = F.col("_b").isNull()
    score = F.coalesce(F.col("_b.tier"), F.lit(0))
    none = F.array().cast("array<string>")
    names = F.when(score > 0, F.col("_b.names")).otherwise(none)
    reason = (F.when(null, F.lit("Skipped: RFP has no department or contractor has no past clients on file."))
              .when(score == 100, F.concat(F.lit("Past work with same agency: "), F.try_element_at(names, F.lit(1)), F.lit(".")))
              .when(score == 70, F.concat(F.lit("Past work with related agency: "), F.try_element_at(names, F.lit(1)), F.lit(".")))
              .when(score == 40, F.concat(F.lit("Past work shares significant agency terms with "), F.try_element_at(names, F.lit(1)), F.lit(".")))
              .otherwise(F.concat(F.lit("No past work with this agency (RFP: "), strip("department"), F.lit(")."))))
    return joined.select(*PAIR, score.alias("score"), null.alias("is_null"), reason.alias("reason"), F.coalesce(names, none).alias("matched_clients"))


# --- prerequisites -----------------------------------------------------------------------

def code_matches(required: Column, held: Column) -> Column:
    """Per required code struct(required, score, held, level): best held code by shared leading digits, first best wins."""
    def one(req: Column) -> Column:
        a = F.regexp_replace(req, r"\D", "")

        def rate(h: Column, i: Column) -> Column:
            b = F.regexp_replace(h, r"\D", "")
            same = lambda n: (F.length(a) >= n) & (F.length(b) >= n) & (F.left(a, F.lit(n)) == F.left(b, F.lit(n)))
            score = F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(same(4), 0.6).when(same(2), 0.3).otherwise(0.0)
            return F.struct(score.alias("score"), (-i).alias("order"), h.alias("held"))

        def named(best: Column) -> Column:
            hit = F.coalesce(best["score"], F.lit(0.0)) > 0
            level = (F.when(best["score"] == 1.0, "exact").when(best["score"] == 0.6, "industry-group")
                     .when(best["score"] == 0.3, "sector").otherwise("none"))
            return F.struct(req.alias("required"), F.coalesce(best["score"], F.lit(0.0)).alias("score"),
                            F.when(hit, best["held"]).otherwise("").alias("held"), level.alias("level"))

        return let(F.array_max(F.transform(held, rate)), named)

    return F.transform(required, one)


CODED = ["required_codes", "held_codes", "set_aside", "set_aside_eligibility"]


def structured_prereqs(pairs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Adds met, unmet, reasons and structured: code list and set-aside as one requirement each.

    Uses the columns of `CODED`; those in `keep` stay.
    """
    def lists(m: Column) -> Column:
        of = lambda level: F.filter(m, lambda x: x["level"] == level)
        codes = lambda level: F.array_join(F.transform(of(level), lambda x: x["required"]), ", ")
        near = lambda level: F.array_join(F.transform(of(level), lambda x: F.concat(x["required"], F.lit("~"), x["held"])), ", ")
        line = lambda level, text, end="": F.when(F.size(of(level)) > 0, F.concat(F.lit(text), codes(level) if level in ("exact", "none") else near(level), F.lit(end)))
        return F.struct(
            F.array(line("exact", "NAICS exact match: "), line("industry-group", "NAICS industry-group match: ")).alias("met"),
            F.array(line("sector", "NAICS sector-only match (2-digit): "), line("none", "NAICS not held: ", ".")).alias("unmet"),
            F.array(*[F.when(F.size(of(level)) > 0, F.concat(F.lit(text), codes(level), F.lit("."))) for level, text in CODE_REASONS]).alias("reasons"))

    wanted = strip(F.coalesce("set_aside", F.lit("")))
    asked = wanted != ""
    held = F.exists("set_aside_eligibility", lambda e: F.lower(e) == F.lower(wanted))
    coded = F.coalesce(F.size("required_codes") > 0, F.lit(False))
    filled = lambda a: F.filter(a, lambda x: x.isNotNull())
    work = pairs.withColumn("_l", F.when(coded, let(code_matches(F.col("required_codes"), F.col("held_codes")), lists)))
    empty = F.array().cast("array<string>")
    met = F.concat(F.coalesce("_l.met", empty), F.array(F.when(asked & held, F.concat(F.lit("Set-aside eligible: "), wanted))))
    unmet = F.concat(F.coalesce("_l.unmet", empty), F.array(F.when(asked & ~held, F.concat(
        F.lit("Set-aside requires "), wanted, F.lit("; contractor not certified.")))))
    aside = F.when(asked & held, F.concat(F.lit("Eligible for "), wanted, F.lit(" set-aside."))).when(asked, F.concat(F.lit("Not certified for "), wanted, F.lit(" set-aside.")))
    return work.select(*PAIR, filled(met).alias("met"), filled(unmet).alias("unmet"), filled(F.concat(F.coalesce("_l.reasons", empty), F.array(aside))).alias("reasons"),
                       (coded.cast("int") + asked.cast("int")).alias("structured"), *keep)


def prereqs(pairs: DataFrame, judgements: DataFrame, requirements: DataFrame | None = None) -> DataFrame:
    """Met share of structured and judged textual requirements.

    `judgements` rows of factor `prereqs` bring met and unmet requirement lists.
    `requirements` (notice_id and a row for each requirement found in its text)
    says how many were judged; without it those the judgement lists count.
    """
    judged = judgements.filter(F.col("factor") == "prereqs").select(*PAIR, F.col("met").alias("_jm"), F.col("unmet").alias("_ju"), F.col("reason").alias("_jr"), F.lit(True).alias("_j"))
    if requirements is not None:  # counted for judged pairs only
        judged = judged.join(requirements.groupBy("notice_id").agg(F.count(F.lit(1)).cast("int").alias("_asked")), "notice_id", "left")
    # The judgement joins the short columns, before the lists are made of them; judgements are hashed, as sorting the pairs would spill.
    joined = structured_prereqs(pairs.select(*PAIR, *CODED).join(by_lot(judged).hint("shuffle_hash"), PAIR, "left"), [c for c in judged.columns if c not in PAIR])
    empty = F.array().cast("array<string>")
    met, unmet = F.concat("met", F.coalesce("_jm", empty)), F.concat("unmet", F.coalesce("_ju", empty))
    textual = F.size(F.coalesce("_jm", empty)) + F.size(F.coalesce("_ju", empty))
    if requirements is not None:
        textual = F.when(F.col("_j"), F.coalesce("_asked", F.lit(0))).otherwise(0)
    total = F.col("structured") + textual
    null = total == 0
    score = round_half_up(F.least(F.size(met), total) / F.nullif(total, F.lit(0)) * 100).cast("int")
    reason = F.when(null, F.lit("Skipped: RFP has no structured eligibility metadata and no extractable textual requirements.")) \
        .otherwise(F.array_join(drop_blank(F.array(F.array_join("reasons", " "), strip(F.coalesce("_jr", F.lit(""))))), " "))
    return joined.select(*PAIR, F.when(null, 0).otherwise(score).alias("score"), null.alias("is_null"), reason.alias("reason"),
                         met.alias("met"), unmet.alias("unmet"), total.alias("total"))


# --- judged factors -------------------------------------------------------------------------

def _judged(judgements: DataFrame, factor: str) -> DataFrame:
    return judgements.filter(F.col("factor") == factor).select(*PAIR, round_half_up(F.col("score").cast("double")).cast("int").alias("_score"), F.col("reason").alias("_reason"))


def experience(pairs: DataFrame, past: DataFrame, judgements: DataFrame, retrieved: DataFrame | None = None) -> DataFrame:
    """Judged score; without past work it is 0 and counts; without a judgement yet it is left out.

    matched_past_projects names the work the judge was shown: `retrieved`
    (contractor_id, notice_id, rank, project_name) where there is any, else the
    first `SHOWN` projects on file.
    """
    filed = top_per_key(past, ["contractor_id"], [F.col("project_id")], SHOWN, rank="rank")
    named = lambda df, keys: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "project_name"))), lambda x: x["project_name"]).alias("_names"))
    # Judgements and names are hashed, as sorting the pairs would spill.
    joined = pairs.select(*PAIR).join(by_lot(_judged(judgements, "experience")).hint("shuffle_hash"), PAIR, "left")
    shown = F.col("_filed")
    if retrieved is not None:
        joined = joined.join(named(retrieved, PAIR), PAIR, "left")
        shown = F.coalesce("_names", "_filed")
    # Last, as it makes the rows wide.
    joined = joined.join(named(by_lot(filed), ["contractor_id"]).withColumnRenamed("_names", "_filed").hint("shuffle_hash"), "contractor_id", "left")
    bare = F.col("_filed").isNull()
    null = ~bare & F.col("_score").isNull()
    none = F.array().cast("array<string>")
    return joined.select(*PAIR, F.when(bare, 0).otherwise(F.coalesce("_score", F.lit(0))).alias("score"), null.alias("is_null"),
                         F.when(bare, "Contractor has no past projects on file.").when(null, "Skipped: not judged yet.").otherwise(F.col("_reason")).alias("reason"),
                         F.when(bare | null, none).otherwise(shown).alias("matched_past_projects"))


def goals(pairs: DataFrame, judgements: DataFrame) -> DataFrame:
    """Judged score; left out when the contractor states no goals or no judgement exists yet.  Uses goals."""
    joined = pairs.select(*PAIR, "goals").join(_judged(judgements, "goals"), PAIR, "left")
    blank = strip(F.coalesce("goals", F.lit(""))) == ""
    null = blank | F.col("_score").isNull()
    return joined.select(*PAIR, F.when(null, 0).otherwise(F.col("_score")).alias("score"), null.alias("is_null"),
                         F.when(blank, "Skipped: contractor has not provided goals text.").when(null, "Skipped: not judged yet.").otherwise(F.col("_reason")).alias("reason"))


# --- total ------------------------------------------------------------------------------------

def weights(df: DataFrame) -> DataFrame:
    """Adds w_<factor>: equal weight over the factors that are not null, over all when every one is."""
    active = sum((F.when(F.col(f"{f}_null"), 0).otherwise(1) for f in FACTORS), F.lit(0))
    out = df.withColumn("_active", active)
    for f in FACTORS:
        out = out.withColumn(f"w_{f}", F.when(F.col("_active") == 0, F.lit(1.0) / len(FACTORS))
                             .when(F.col(f"{f}_null"), 0.0).otherwise(F.lit(1.0) / F.col("_active")))
    return out.drop("_active")


def total(df: DataFrame) -> DataFrame:
    """Adds total: weighted sum in percent; timing is 0 or 1, the others 0 to 100; an exclusion makes it 0."""
    parts = F.lit(0.0)
    for f in FACTORS:
        parts = parts + F.col(f) / (1.0 if f == "timing" else 100.0) * F.col(f"w_{f}")
    return df.withColumn("total", F.when(F.col("excluded"), 0).otherwise(round_half_up(parts * 100)).cast("int"))


def breakdown(df: DataFrame) -> DataFrame:
    """Adds null_factors, reasoning, model_version and `factors`, the whole breakdown as one struct.

    `factors` holds total, weights, for each factor its score, reason and details
    (columns ``<factor>_reason`` and ``<factor>_<detail>``), null_factors, the
    exclusion where there is one, and model_version.
    """
    nulls = F.filter(F.array(*[F.when(F.col(f"{f}_null"), F.lit(f)) for f in FACTORS]), lambda x: x.isNotNull())
    line = F.array_join(F.array(*[F.concat(F.lit(f"{f}: "), F.col(f).cast("string")) for f in FACTORS]), "; ")
    plain = F.concat(F.lit("Compatibility "), F.col("total").cast("string"), F.lit("/100. "), line, F.lit("."))
    each = [F.struct(F.col(f).alias("score"), F.col(f"{f}_reason").alias("reason"), *[F.col(f"{f}_{d}").alias(d) for d in DETAILS.get(f, ())]).alias(f) for f in FACTORS]
    out = df.withColumn("null_factors", nulls).withColumn("reasoning", F.when(F.col("excluded"), F.col("exclusion_reason")).otherwise(plain)) \
        .withColumn("model_version", F.lit(MODEL_VERSION))
    return out.withColumn("factors", F.struct(
        "total", F.struct(*[F.col(f"w_{f}").alias(f) for f in FACTORS]).alias("weights"), F.struct(*each).alias("factors"), "null_factors",
        F.when(F.col("excluded"), F.struct(F.col("excluded_term").alias("term"), F.col("exclusion_reason").alias("reason"))).alias("excluded"), "model_version"))


def pair_inputs(pairs: DataFrame, contractors: DataFrame, notices: DataFrame) -> DataFrame:
    """Pairs with the short columns the row-wise factors read; texts stay out."""
    c = contractors.select("contractor_id", "preferred_response_window_days", "preferred_locations", "goals",
                           "set_aside_eligibility", F.col("naics_codes").alias("held_codes"))
    n = notices.select("notice_id", "due_date", "state", "location", "department", "set_aside", F.col("naics_codes").alias("required_codes"))
    return join_sides(pairs.select(*PAIR), c, n)
