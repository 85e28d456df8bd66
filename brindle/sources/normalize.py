"""Source records to canonical entities: one select-based function for each kind of record.

Each returns {entity: DataFrame}. Rows without the id their source must give go to quarantine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import ids, text
from brindle.session import settle, unsettle


def _envelope(system: str, source_id: Column, url: Column | None = None) -> Column:
    return F.struct(ids.record_id(F.lit(system), source_id).alias("id"), F.lit(system).alias("source_system"), source_id.alias("source_id"), (url if url is not None else F.lit(None).cast("string")).alias("source_url"), F.create_map(F.lit(system), source_id).alias("external_ids"))


def _col(df: DataFrame, *names: str) -> Column:
    """The first of some columns that exist, null where none does."""
    have = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def quarantine(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(good, F.lit(False))
    return df.where(ok), df.where(~ok)


def court_search_hit(df: DataFrame) -> dict[str, DataFrame]:
    """A case-law search hit: its document, proceeding and court."""
    good, bad = quarantine(df, text.numeric_id(_col(df, "cluster_id", "id")))
    cluster, docket, court = _col(good, "cluster_id", "id"), _col(good, "docket_id"), _col(good, "court_id")
    return {
        "document": good.select(_envelope("courtlistener", cluster, _col(good, "absolute_url")).alias("envelope"), F.lit("opinion").alias("doc_type"), _col(good, "caseName", "case_name").alias("title"), text.lenient_date(_col(good, "dateFiled", "date_filed")).alias("date_issued"), _col(good, "status").alias("status"), ids.record_id(F.lit("courtlistener"), docket).alias("proceeding_id"), ids.record_id(F.lit("courtlistener"), court).alias("issuing_body_id")),
        "proceeding": good.where(docket.isNotNull()).select(_envelope("courtlistener", docket).alias("envelope"), F.lit("case").alias("proceeding_type"), _col(good, "docketNumber", "docket_number").alias("number"), _col(good, "caseName", "case_name").alias("title"), ids.record_id(F.lit("courtlistener"), court).alias("organization_id"), text.lenient_date(_col(good, "dateFiled", "date_filed")).alias("date_filed")),
        "organization": good.where(court.isNotNull()).select(_envelope("courtlistener", court).alias("envelope"), F.lit("court").alias("org_type"), _col(good, "court").alias("name")).dropDuplicates(["name"]),
        "quarantine": bad,
    }


def court_person(df: DataFrame) -> dict[str, DataFrame]:
    good, bad = quarantine(df, text.numeric_id(_col(df, "id")))
    return {"person": good.select(_envelope("courtlistener", _col(good, "id")).alias("envelope"), F.array(F.lit("judge")).alias("role_types"), _col(good, "name_first").alias("name_first"), _col(good, "name_middle").alias("name_middle"), _col(good, "name_last").alias("name_last"), _col(good, "name_suffix").alias("name_suffix"), text.lenient_date(_col(good, "date_dob")).alias("date_of_birth"), _col(good, "gender").alias("gender")), "quarantine": bad}


def court(df: DataFrame) -> dict[str, DataFrame]:
    """A court of the bulk files; its parent is another court."""
    good, bad = quarantine(df, F.length(F.trim(_col(df, "id"))) > 0)
    parent = F.nullif(F.trim(_col(good, "parent_court_id", "parent_court")), F.lit(""))
    return {"organization": good.select(_envelope("courtlistener", _col(good, "id"), _col(good, "url")).alias("envelope"), F.lit("court").alias("org_type"), _col(good, "full_name", "name").alias("name"), _col(good, "short_name").alias("short_name"), _col(good, "jurisdiction").alias("jurisdiction"), ids.record_id(F.lit("courtlistener"), parent).alias("parent_org_id")), "quarantine": bad}


def disclosure(df: DataFrame) -> dict[str, DataFrame]:
    """A judge's financial disclosure with its scan."""
    good, bad = quarantine(df, text.numeric_id(_col(df, "id")))
    pdf = _col(good, "filepath", "pdf_url")
    return {
        "financial_disclosure": good.select(
            _envelope("courtlistener", F.concat(F.lit("disclosure:"), _col(good, "id"))).alias("envelope"), ids.record_id(F.lit("courtlistener"), _col(good, "person_id")).alias("person_id"), _col(good, "year").try_cast("int").alias("year"),
            F.coalesce(_col(good, "has_been_extracted").try_cast("boolean"), F.lit(False)).alias("extracted"), F.coalesce(_col(good, "is_amended").try_cast("boolean"), F.lit(False)).alias("amended"), _col(good, "page_count").try_cast("int").alias("page_count"), text.media_links(pdf=pdf).alias("media")),
        "quarantine": bad,
    }


def citation_stubs(df: DataFrame) -> dict[str, DataFrame]:
    """A document for each reporter citation of a hit that names no opinion of its own."""
    good, bad = quarantine(df, text.numeric_id(_col(df, "cluster_id", "id")))
    said = good.select(_col(good, "cluster_id", "id").alias("citing"), F.explode("citation").alias("cite")).where("trim(cite) <> ''").select("citing", text.collapse_space(F.col("cite")).alias("cite")).distinct()
    return {"citation": said.select(ids.record_id(F.lit("courtlistener"), F.col("citing")).alias("citing_id"), ids.record_id(F.lit("citation"), F.col("cite")).alias("cited_id"), F.col("cite").alias("cited_as"), F.lit("cited").alias("treatment")), "quarantine": bad}


def court_docket(df: DataFrame) -> dict[str, DataFrame]:
    good, bad = quarantine(df, text.numeric_id(_col(df, "id")))
    return {"proceeding": good.select(_envelope("courtlistener", _col(good, "id")).alias("envelope"), F.lit("case").alias("proceeding_type"), _col(good, "docket_number").alias("number"), _col(good, "case_name").alias("title"), ids.record_id(F.lit("courtlistener"), _col(good, "court_id")).alias("organization_id"), text.lenient_date(_col(good, "date_filed")).alias("date_filed")), "quarantine": bad}


def court_cluster(df: DataFrame) -> dict[str, DataFrame]:
    good, bad = quarantine(df, text.numeric_id(_col(df, "id")))
    summary = text.labelled(summary=_col(good, "summary"), syllabus=_col(good, "syllabus"), headnotes=_col(good, "headnotes"), posture=_col(good, "posture"), disposition=_col(good, "disposition"))
    return {"document": good.select(_envelope("courtlistener", _col(good, "id")).alias("envelope"), F.lit("opinion").alias("doc_type"), _col(good, "case_name").alias("title"), text.lenient_date(_col(good, "date_filed")).alias("date_issued"), _col(good, "precedential_status").alias("status"), F.nullif(summary, F.lit("")).alias("summary")), "quarantine": bad}


def enriched_clusters(clusters: DataFrame, dockets: DataFrame, citations: DataFrame) -> DataFrame:
    """Clusters with the court of their docket and the list of clusters they cite, in order.

    clusters: id, docket_id; dockets: id, court_id; citations: citing_cluster_id, cited_cluster_id."""
    courts = dockets.groupBy(F.col("id").alias("docket_id")).agg(F.min("court_id").alias("jurisdiction"))
    cites = citations.where("citing_cluster_id is not null and cited_cluster_id is not null").groupBy(F.col("citing_cluster_id").alias("id")).agg(F.array_sort(F.collect_set("cited_cluster_id")).alias("cites"))
    return clusters.join(courts, "docket_id", "left").join(cites, "id", "left").withColumn("cites", F.coalesce("cites", F.array().cast("array<string>")))


def regulation_agency(df: DataFrame) -> dict[str, DataFrame]:
    good, bad = quarantine(df, F.length(F.trim(_col(df, "slug"))) > 0)
    return {"organization": good.select(_envelope("ecfr", _col(good, "slug")).alias("envelope"), F.lit("agency").alias("org_type"), _col(good, "display_name", "name").alias("name"), _col(good, "short_name").alias("short_name"), ids.record_id(F.lit("ecfr"), _col(good, "parent_slug")).alias("parent_org_id")), "quarantine": bad}


def regulation_section(df: DataFrame) -> dict[str, DataFrame]:
    sid = F.concat_ws("-", _col(df, "title_number", "title"), _col(df, "section", "identifier"))
    return {"document": df.select(_envelope("ecfr", sid).alias("envelope"), F.lit("cfr_section").alias("doc_type"), _col(df, "heading", "label").alias("title"), _col(df, "hierarchy_path").alias("hierarchy_path"), text.strip_html(_col(df, "text", "content")).alias("plain_text"))}


# The kinds of document that government collections hold.
COLLECTIONS = {"BILLS": "bill", "FR": "federal_register_notice", "CFR": "cfr_section", "CRPT": "committee_report", "USCOURTS": "opinion"}


def government_package(df: DataFrame) -> dict[str, DataFrame]:
    kinds = F.create_map(*[F.lit(x) for p in COLLECTIONS.items() for x in p])
    good, bad = quarantine(df, _col(df, "packageId").isNotNull())
    return {"document": good.select(_envelope("govinfo", _col(good, "packageId"), _col(good, "packageLink")).alias("envelope"), F.coalesce(F.try_element_at(kinds, _col(good, "collectionCode")), F.lit("other")).alias("doc_type"), _col(good, "title").alias("title"), text.lenient_date(_col(good, "dateIssued")).alias("date_issued")), "quarantine": bad}


def congress_bill(df: DataFrame) -> dict[str, DataFrame]:
    sid = F.concat_ws("-", _col(df, "congress"), F.lower(_col(df, "type")), _col(df, "number"))
    return {
        "proceeding": df.select(_envelope("congress", sid).alias("envelope"), F.lit("bill").alias("proceeding_type"), _col(df, "number").alias("number"), _col(df, "title").alias("title"), text.lenient_date(_col(df, "introducedDate")).alias("date_filed")),
        "document": df.select(_envelope("congress", F.concat(sid, F.lit(":text"))).alias("envelope"), F.lit("bill").alias("doc_type"), _col(df, "title").alias("title"), ids.record_id(F.lit("congress"), sid).alias("proceeding_id")),
    }


def congress_member(df: DataFrame) -> dict[str, DataFrame]:
    parts = text.name_parts(_col(df, "name"))
    return {"person": df.select(_envelope("congress", _col(df, "bioguideId")).alias("envelope"), F.array(F.lit("legislator")).alias("role_types"), parts["first"].alias("name_first"), parts["middle"].alias("name_middle"), parts["last"].alias("name_last"), _col(df, "partyName").alias("party"), _col(df, "state").alias("state"))}


def congress_committee(df: DataFrame) -> dict[str, DataFrame]:
    good, bad = quarantine(df, F.length(F.trim(_col(df, "systemCode"))) > 0)
    return {"organization": good.select(_envelope("congress", _col(good, "systemCode"), _col(good, "url")).alias("envelope"), F.lit("committee").alias("org_type"), _col(good, "name").alias("name"), F.lower(_col(good, "chamber")).alias("chamber"), ids.record_id(F.lit("congress"), _col(good, "parentCode")).alias("parent_org_id")), "quarantine": bad}


def argued_case(df: DataFrame) -> dict[str, DataFrame]:
    """A case with its court and its advocates (array<struct<name, role>>)."""
    good, bad = quarantine(df, F.length(F.trim(_col(df, "ID", "id"))) > 0)
    key = _col(good, "ID", "id")
    court_name = F.coalesce(_col(good, "court"), F.lit("Supreme Court of the United States"))
    where = text.place(_col(good, "venue"), _col(good, "city"), _col(good, "state"), _col(good, "latitude"), _col(good, "longitude"))
    out = {
        "proceeding": good.select(_envelope("oyez", key, _col(good, "href")).alias("envelope"), F.lit("case").alias("proceeding_type"), _col(good, "docket_number").alias("number"), _col(good, "name").alias("title"), ids.record_id(F.lit("oyez"), court_name).alias("organization_id"), text.date_in_title(_col(good, "decided")).alias("date_decided"), where.alias("location")),
        "organization": good.select(court_name.alias("name")).distinct().select(_envelope("oyez", F.col("name")).alias("envelope"), F.lit("court").alias("org_type"), "name"),
        "quarantine": bad,
    }
    if "advocates" in df.columns:
        parts = text.name_parts(F.col("a.name"))
        people = good.select(F.explode("advocates").alias("a")).where("trim(a.name) <> ''").select("a").distinct()
        out["person"] = people.select(_envelope("oyez", F.concat(F.lit("advocate:"), F.lower(F.trim("a.name")))).alias("envelope"), F.array(F.lit("advocate")).alias("role_types"), parts["first"].alias("name_first"), parts["middle"].alias("name_middle"), parts["last"].alias("name_last"))
    return out


def oral_argument(df: DataFrame) -> dict[str, DataFrame]:
    """Sections of turns of text blocks, flattened to one array of segments."""
    turns = F.flatten(F.transform("sections", lambda s: F.coalesce(s["turns"], F.array())))
    segments = F.transform(turns, lambda t: F.struct(t["start"].cast("double").alias("start_seconds"), t["stop"].cast("double").alias("end_seconds"), t["speaker"].alias("speaker"), F.array_join(F.transform(t["text_blocks"], lambda b: b["text"]), " ").alias("text")))
    return {"document": df.select(_envelope("oyez", _col(df, "id")).alias("envelope"), F.lit("oral_argument").alias("doc_type"), _col(df, "title").alias("title"), text.date_in_title(_col(df, "title")).alias("date_issued"), segments.alias("segments"))}


def edges(citations: DataFrame, clusters: DataFrame) -> DataFrame:
    """Citations with the cited opinion's cluster, or a placeholder where it has none."""
    first = clusters.groupBy("opinion_id").agg(F.min("cluster_id").alias("_cluster"))
    c = citations.where("cited_opinion_id is not null")
    return c.join(first, F.col("cited_opinion_id") == F.col("opinion_id"), "left").withColumn("cited", F.coalesce("_cluster", F.concat(F.lit("opinion:"), "cited_opinion_id"))).drop("_cluster", "opinion_id")


def raw_edges(citations: DataFrame) -> DataFrame:
    """A citation map as edges, without looking its opinions up: ids derive from the numbers alone."""
    good = citations.where(text.numeric_id(F.trim("citing_opinion_id")) & text.numeric_id(F.trim("cited_opinion_id")))
    ref = lambda c: ids.record_id(F.lit("courtlistener"), F.concat(F.lit("opinion:"), F.trim(c)))
    return good.select(ref("citing_opinion_id").alias("citing_id"), ref("cited_opinion_id").alias("cited_id"), "depth")


def hierarchy(nodes: DataFrame, glue: str = " > ") -> DataFrame:
    """(id, path) of every node that hangs on a root, of trees of any depth, given as (id, parent, name).

    Paths are doubled, not walked: in round k each node knows the path to its ancestor 2^k levels up, so
    a tree of d levels takes log2(d) joins. Nodes on a cycle hang on no root and give no row."""
    at = settle(nodes.select("id", F.col("parent").alias("up"), F.col("name").alias("path")))
    spans, every = 1, at.count()
    while spans < 2 * max(every, 1) and not at.where("up is not null").isEmpty():
        above = at.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("path").alias("above"), F.lit(True).alias("known"))
        # a parent that isn't there leaves its child without a root
        joined = at.join(above, "up", "left").where("up is null or known")
        old, at = at, settle(joined.select("id", F.col("further").alias("up"), F.when(F.col("known"), F.concat("above", F.lit(glue), "path")).otherwise(F.col("path")).alias("path")))
        unsettle(old)
        spans *= 2
    return at.where("up is null").select("id", "path")


KINDS: dict[str, Callable[[DataFrame], dict[str, DataFrame]]] = {"search_hit": court_search_hit, "person": court_person, "docket": court_docket, "cluster": court_cluster, "cfr_section": regulation_section, "govinfo_package": government_package, "court": court, "disclosure": disclosure, "citation_stub": citation_stubs, "agency": regulation_agency, "committee": congress_committee, "case": argued_case, "bill": congress_bill, "member": congress_member, "oral_argument": oral_argument}


def normalize(kind: str, df: DataFrame) -> dict[str, DataFrame]:
    if kind not in KINDS:
        raise ValueError(f"no record kind {kind!r}; known: {', '.join(KINDS)}")
    return KINDS[kind](df)
