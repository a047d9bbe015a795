"""Rules that look beyond their paragraph: at the document's sections, abbreviations or code blocks.

Each is a join on the document, never a lookup on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions import scalars as S
from veritab.functions.matches import let, matches
from veritab.operators import relational
from veritab.operators.catalogue import BY_ID, ORDER
from veritab.operators.rules import attributes_of, gate, hit, tagged
from veritab.operators.top_overlap import best_by_overlap

B, W = S.WB, S.WS
def none() -> Column:
    return F.lit(None).cast("string")


#: Acronyms whose expansion an outside standard sets.
STANDARDS = [
    ("ATC", "(?i)^anatomical therapeutic chemical", "anatomical_therapeutic_chemical", "WHO Collaborating Centre for Drug Statistics Methodology"),
    ("MedDRA", "(?i)^medical dictionary for regulatory activities", "medical_dictionary_for_regulatory_activities", "ICH"),
    ("CTCAE", "(?i)^common terminology criteria for adverse events", "common_terminology_criteria", "US National Cancer Institute"),
]
#: How references are written, and words before a name.
REFERENCE = rf"(?i){B}(APPENDIX{W}+\d+|Section{W}+\d+(?:\.\d+)*){B}"
SUBJECT = rf"(?i){B}(?:see|refer to){W}+(?:APPENDIX{W}+\d+|Section{W}+\d+(?:\.\d+)*){W}+for{W}+([^.]{{4,90}})"
TITLED = rf"(?i){B}appendix{W}+(\d+){W}*:{W}*([A-Za-z][^,;.]{{2,60}}?)(?={W}+and{W}+appendix{B}|[,;.]|$)"
PAGE = rf"((?:[A-Za-z(][A-Za-z0-9()\-]*{W}+){{1,5}})(?:eCRF{W}+)?page{B}"
ARTICLES = ["the", "a", "an", "this", "that", "these", "those", "each"]


def with_rule(df: DataFrame, rule_id: str, columns: list[str], order: Column, value: Column) -> DataFrame:
    """df's paragraphs with the rule's columns and one hit a row, in the rule's order."""
    rule = BY_ID[rule_id]
    own = df.withColumn("_h", F.get(tagged(rule, ORDER[rule_id], F.array(value)), F.lit(0))).withColumn("_h", F.col("_h").withField("hitOrd", order.cast("int")))
    return own.select(*columns, "_h.*")


def acronyms(paragraphs: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """A fact for each abbreviation, at the paragraph that the first one of the document was read from."""
    rule = "terminology.acronym_definition"
    first = abbreviations.groupBy("documentId").agg(F.min_by("paragraphId", "abbrSeq").alias("paragraphId"))
    at = paragraphs.where(gate(BY_ID[rule])).join(first, ["documentId", "paragraphId"]).join(abbreviations.select("documentId", "abbrSeq", "acronym", "expansion"), "documentId")
    single = F.when(F.col("acronym").rlike("^[A-Z]{2,}s$"), F.expr("left(acronym, length(acronym) - 1)")).otherwise(F.col("acronym"))
    raw = F.concat("acronym", F.lit(" — "), "expansion")
    index = F.greatest(F.expr("instr(text, acronym)") - 1, F.lit(0))
    rows = at.withColumns({"_s": single, "_raw": raw, "_i": index})
    own = with_rule(rows, rule, paragraphs.columns, F.col("abbrSeq") * 10, hit(F.concat(F.lit("acronym."), "_s"), F.col("_raw"), S.term(F.col("expansion")), none(), F.col("_i"), attributes_of({"acronym": F.col("acronym")})))
    for k, (acronym, pattern, slug, source) in enumerate(STANDARDS):
        part = rows.where(F.col("expansion").rlike(pattern))
        own = own.unionByName(with_rule(part, rule, paragraphs.columns, F.col("abbrSeq") * 10 + k + 1, hit(F.lit(f"standard.acronym.{slug}"), F.col("_raw"), F.col("acronym"), none(), F.col("_i"), attributes_of({"expected": F.lit(acronym), "source": F.lit(source)}))))
    return own


def target(reference: Column) -> Column:
    appendix, section = r"(?i)APPENDIX\s+(\d+)", r"(?i)Section\s+(\d+(?:\.\d+)*)"
    return F.when(reference.rlike(appendix), F.concat(F.lit("APPENDIX "), F.regexp_extract(reference, appendix, 1))).when(reference.rlike(section), F.regexp_extract(reference, section, 1)).otherwise(F.upper(reference))


def references(paragraphs: DataFrame, sections: DataFrame) -> DataFrame:
    """References to sections and appendices with the verdict whether they hold."""
    text = F.col("text")
    plain, titled = "crossref.reference_resolution", "crossref.numbered_title_reference"
    near = F.transform(matches(text, SUBJECT, 1), lambda m: F.struct(m["index"].alias("at"), m["m"][1].alias("subject")))

    def subject_of(subjects: Column, index: Column) -> Column:
        own = F.filter(subjects, lambda s: (index >= s["at"]) & (index <= s["at"] + 40))
        return F.get(F.transform(F.slice(F.reverse(own), 1, 1), lambda s: s["subject"]), F.lit(0))

    found = F.filter(matches(text, REFERENCE, 1), lambda m: F.substr(text, m["index"] + F.length(m["m"][0]) + 1, F.lit(1)) != ":")
    shape = lambda rule, m, to, subject: F.struct(F.lit(rule).alias("rule"), m["index"].alias("index"), m["m"][0].alias("raw"), to.alias("target"), subject.alias("subject"))
    one = let({"found": found, "near": near}, lambda v: F.transform(v["found"], lambda m: shape(plain, m, target(m["m"][1]), subject_of(v["near"], m["index"]))))
    two = F.transform(matches(text, TITLED, 2), lambda m: shape(titled, m, F.concat(F.lit("APPENDIX "), m["m"][1]), m["m"][2]))
    empty = F.array().cast("array<struct<rule:string,index:int,raw:string,target:string,subject:string>>")
    each = relational.dealt(paragraphs).select("*", F.posexplode(F.concat(F.when(gate(BY_ID[plain]), one).otherwise(empty), F.when(gate(BY_ID[titled]), two).otherwise(empty))).alias("_pos", "_r"))
    each = each.withColumn("_subject", S.content_tokens(F.col("_r.subject")))
    bare = sections.select("documentId", "sectionSeq", F.regexp_replace("id", r"#\d+$", "").alias("bare"), "heading")
    cited = bare.groupBy("documentId", F.upper("bare").alias("_to")).agg(F.min_by("heading", "sectionSeq").alias("_cited"))
    cited = relational.cut(cited.select(F.struct("documentId", "_to").alias("_at"), "_cited", S.content_tokens(F.col("_cited")).alias("_cites")))
    each = relational.cut(each.withColumn("_to", F.upper("_r.target")).withColumn("_at", F.struct("documentId", "_to")))
    each = relational.looked_up(each, cited, "_at", "left").drop("_at")  # rows stay in the tasks that they were dealt to
    # The best section for a described reference: most shared tokens, the first of ties.
    each = relational.cut(each.withColumn("_ask", F.when(F.col("_subject").isNotNull(), F.struct(F.col("documentId").alias("key"), F.col("_subject").alias("subject")))))
    held = bare.select(F.col("documentId").alias("key"), F.col("sectionSeq").alias("seq"), S.content_tokens(F.col("heading")).alias("tokens"))
    best = best_by_overlap(each.where("_ask IS NOT NULL").select("_ask.*"), held)
    best = best.join(bare.select(F.col("documentId").alias("key"), F.col("sectionSeq").alias("seq"), "bare", "heading"), ["key", "seq"])
    best = best.select(F.struct("key", "subject").alias("_ask"), F.struct("bare", "heading", F.col("score").alias("_s")).alias("_best"))
    each = relational.looked_up(each, relational.cut(best), "_ask", "left")
    each = each.withColumn("_wrong", F.coalesce((F.col("_best._s") > S.overlap(F.col("_subject"), F.col("_cites"))) & (F.upper("_best.bare") != F.col("_to")), F.lit(False)))
    wrong = F.col("_wrong")
    absent = F.col("_cited").isNull()
    value = (
        F.when(absent, F.concat(F.lit("UNRESOLVED — "), F.col("_r.target"), F.lit(" does not exist in this document")))
        .when(wrong, F.concat(F.col("_r.target"), F.lit(' is "'), F.col("_cited"), F.lit('", but "'), S.tidy(F.col("_r.subject")), F.lit('" is '), F.col("_best.bare"), F.lit(' "'), F.col("_best.heading"), F.lit('"'))).otherwise("RESOLVED")
    )
    value = F.when(~absent & wrong, F.concat(F.lit("MISMATCH — "), value)).otherwise(value)
    made = hit(F.lit("crossref.integrity"), S.tidy(F.col("_r.raw")), value, none(), F.col("_r.index"), attributes_of({"expected": F.lit("RESOLVED"), "target": F.col("_r.target"), "actualTarget": F.when(~absent & wrong, F.col("_best.bare"))}))
    parts = [with_rule(each.where(F.col("_r.rule") == r), r, paragraphs.columns, F.col("_pos"), made) for r in (plain, titled)]
    return parts[0].unionByName(parts[1])


def page_references(paragraphs: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """Named pages, with the tokens of their names once acronyms are spelt out."""
    rule = "crf_mapping.page_reference"

    def name_of(prefix: Column) -> Column:
        tokens = F.filter(F.split(F.trim(prefix), W + "+"), lambda t: (t != "") & (F.lower(t) != "ecrf"))
        last = lambda v: F.aggregate(F.transform(v["tokens"], lambda t, i: F.when(F.lower(t).isin(ARTICLES), i).otherwise(-1)), F.lit(-1), lambda a, i: F.greatest(a, i))
        after = lambda v: F.when(v["last"] >= 0, F.slice(v["tokens"], v["last"] + 2, F.greatest(F.size(v["tokens"]), F.lit(1))))
        name = lambda v: F.trim(F.regexp_replace(F.array_join(after(v), " "), "[,;:]$", ""))
        return let({"tokens": tokens}, lambda v: let({"tokens": v["tokens"], "last": last(v)}, lambda v: let({"name": name(v)}, lambda v: F.when(F.length(v["name"]) >= 2, v["name"]))))

    named = F.filter(F.transform(matches(F.col("text"), PAGE, 1), lambda m: F.struct(m["index"].alias("index"), m["m"][0].alias("raw"), name_of(m["m"][1]).alias("name"))), lambda m: m["name"].isNotNull())
    first = let({"named": named}, lambda v: let({"named": v["named"], "names": F.transform(v["named"], lambda o: o["name"])}, lambda v: F.filter(v["named"], lambda m, k: F.array_position(v["names"], m["name"]) == k + 1)))
    each = relational.cut(relational.dealt(paragraphs).where(gate(BY_ID[rule])).select("*", F.posexplode(first).alias("_pos", "_m")))
    known = abbreviations.groupBy("documentId", F.lower("acronym").alias("_a")).agg(F.max_by("expansion", "abbrSeq").alias("_x"))
    words = each.select("documentId", "docSeq", "sectionSeq", "paraSeq", "_pos", F.posexplode(F.split("_m.name", W + "+")).alias("_k", "_w"), F.size(F.split("_m.name", W + "+")).alias("_n"))
    spelt = words.withColumn("_a", F.when((F.col("_n") == 1) | F.col("_w").rlike(r"^\(.*\)$"), F.lower(F.regexp_replace("_w", "[()]", "")))).join(known, ["documentId", "_a"], "left")
    key = ["documentId", "docSeq", "sectionSeq", "paraSeq", "_pos"]
    whole = spelt.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.coalesce("_x", "_w").alias("w")))), lambda x: x["w"]), " ").alias("_name"))
    whole = whole.withColumn("_tokens", F.array_distinct(S.content_tokens(F.col("_name"))))
    each = each.join(whole, key).where(F.size("_tokens") > 0)
    return with_rule(each, rule, paragraphs.columns, F.col("_pos"), hit(F.lit("crf_page.reference"), S.tidy(F.col("_m.raw")), F.col("_m.name"), none(), F.col("_m.index"), attributes_of({"tokens": F.array_join("_tokens", "|")})))


def dataset_flows(paragraphs: DataFrame) -> DataFrame:
    """For each section with code, at its first code paragraph: whether it reads one dataset only."""
    rule = "derivation.dataset_flow"
    code = paragraphs.where(gate(BY_ID[rule]))
    lines = code.select("documentId", "sectionSeq", F.explode("lines").alias("line"))
    low = lambda p: F.transform(F.regexp_extract_all("line", F.lit(p), F.lit(1)), F.lower)
    inputs = F.concat(low(rf"(?i){B}data\s*=\s*([a-z][a-z0-9_]*)"), low(r"(?i)^\s*(?:set|use)\s+([a-z][a-z0-9_]*)"))
    flow = lines.groupBy("documentId", "sectionSeq").agg(
        F.array_distinct(F.flatten(F.collect_set(inputs))).alias("read"), F.flatten(F.collect_set(low(r"(?i)^\s*data\s+([a-z][a-z0-9_]*)\s*;"))).alias("created"), F.bool_or(F.col("line").rlike(rf"(?i){B}merge{B}")).alias("merged")
    )
    flow = flow.withColumn("external", F.array_sort(F.array_except("read", "created")))
    first = code.withColumn("_n", F.row_number().over(Window.partitionBy("documentId", "sectionSeq").orderBy("paraSeq"))).where("_n = 1").drop("_n")
    each = first.join(flow, ["documentId", "sectionSeq"], "left")
    several = F.coalesce((F.size("external") > 1) & ~F.col("merged"), F.lit(False))
    shown = F.coalesce(F.nullif(F.array_join("external", ", "), F.lit("")), F.lit("none"))
    value = F.when(several, F.concat(F.size("external").cast("string"), F.lit(" UNRELATED INPUTS — "), F.array_join("external", ", "))).otherwise("SINGLE INPUT")
    made = hit(F.lit("derivation.dataset_consistency"), F.concat(F.lit("input dataset(s): "), shown), value, none(), F.lit(0), attributes_of({"expected": F.lit("SINGLE INPUT"), "section": F.col("sectionId")}))
    return with_rule(each, rule, paragraphs.columns, F.lit(0), made)
