"""Gates and ordered reject-reason policies. A policy is one CASE: the first rule that holds gives the reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import text as tx

#: Provenance lists, term lists and patterns.
MATH_HOSTS = [
    "math.stackexchange.com", "physics.stackexchange.com", "stats.stackexchange.com", "cs.stackexchange.com",
    "cstheory.stackexchange.com", "puzzling.stackexchange.com", "electronics.stackexchange.com", "mathoverflow.net",
    "physicsforums.com", "mathhelpforum.com", "mathforum.org", "mymathforum.com", "tanyakhovanova.com", "openstax.org",
    "libretexts.org", "khanacademy.org", "ck12.org", "maths.org", "mathworld.wolfram.com", "encyclopediaofmath.org",
    "en.wikipedia.org", "proofwiki.org", "themathdoctors.org", "mathisfun.com", "cut-the-knot.org",
    "betterexplained.com", "brilliant.org", "rosettacode.org",
]
MATH_SUFFIXES = [".edu", ".ac.uk", ".edu.au", ".edu.in", ".edu.cn", ".ac.nz"]
WEB_HOSTS = [
    "en.wikipedia.org", "en.wikibooks.org", "en.wikisource.org", "openstax.org", "libretexts.org", "khanacademy.org",
    "ck12.org", "britannica.com", "bbc.co.uk", "bbc.com", "smithsonianmag.com", "nationalgeographic.com",
    "scientificamerican.com", "sciencenews.org", "sciencedaily.com", "quantamagazine.org", "worldhistory.org",
    "science.org", "nature.com", "rsc.org", "aps.org", "ams.org", "royalsociety.org", "nhs.uk", "oercommons.org",
    "europeana.eu", "si.edu", "nctm.org", "readwritethink.org",
]
WEB_SUFFIXES = [".edu", ".ac.uk", ".edu.au", ".edu.in", ".edu.cn", ".ac.nz", ".gov", ".gov.uk", ".gov.au", ".gc.ca", ".sch.uk"]
AGGREGATE_PATH = r"(?i)/(?:tag|tags|search|category|categories|feed|rss)(?:/|\?|$)"
ESSAY_MILL = (
    r"(?i)\b(?:sample term paper|ace my homework|(?:write|buy|order) my essay|do my homework|buy essays?|"
    r"hire (?:an? )?(?:essay|homework) writer|plagiarism[- ]free (?:essay|paper)|essay writing service|"
    r"custom essay(?:s| writing)?|homework writing service)\b"
)
PRESS_WIRE = r"(?i)\b(?:PRNewswire|PR Newswire|PRWEB|Business Wire)\b"
NAVIGATION = r"(?mi)^#?\s*(?:month:|search by topic|resources tagged with)"
LOST_NOTATION = r"(?i)\blet be a (?:curve|function) in\s*\."
EXPLICIT = r"(?i)\b(?:porn(?:ography|ographic|hub)?|blowjobs?|handjobs?|cumshots?|gangbang|deepthroat|anal sex|sex with her|sex with him)\b"
GLOSSARY = r"(?i)\b\d+ definitions by\b"
FUNCTION_WORDS = "the and of to in a was he she it that his her with as for had on at by not from they you i is".split()
NARRATIVE_TITLE = r"(?i)\b(?:novels?|novellas?|stor(?:y|ies)|tales?|adventures?|myster(?:y|ies)|romances?|memoirs?|recollections?|autobiograph(?:y|ies))\b"
OTHER_TITLE = (
    r"(?i)\b(?:complete works|bible|scriptures?|testament|psalms?|poems?|poetry|verse|dramas?|plays?|sermons?|prayers?|"
    r"hymns?|magazines?|journals?|periodicals?|dictionar(?:y|ies)|encyclop(?:ae|e)dia|catalog(?:ue)?s?|cookery|cookbooks?|"
    r"recipes?|constitution|declaration|statutes?)\b"
)
CAPTION_EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?:\+?\d[\d\s().-]{7,}\d)"
LINK = r"(?i)(?:https?://|www\.)"
PERSON_TERMS = [
    "man", "men", "woman", "women", "boy", "boys", "girl", "girls", "person", "persons", "people", "child", "children",
    "baby", "babies", "gentleman", "gentlemen", "lady", "ladies", "crowd", "family", "human", "humans", "kid", "kids",
    "infant", "infants", "toddler", "toddlers", "teen", "teens", "teenager", "teenagers", "adult", "adults", "worker",
    "workers", "pedestrian", "pedestrians", "tourist", "tourists", "athlete", "athletes", "rider", "riders", "couple",
    "couples", "bride", "groom",
]
HIGH_RISK = [
    "nude", "naked", "porn", "sexual", "sex", "weapon", "gun", "rifle", "blood", "corpse", "dead", "injury", "hospital",
    "patient", "passport", "license plate", "credit card", "address", "phone number", "email address",
]
URL_MARKERS = ["coco", "docvqa", "gqa", "infographicvqa", "infovqa", "mathvista", "mmmu", "okvqa", "scienceqa", "textvqa", "vizwiz", "vqa"]
REFUSALS = ["i cannot see", "i can't see", "unable to determine", "cannot determine", "not possible to tell"]
CODE_MIN_SCORE = {"Python": 3, "JavaScript": 3, "TypeScript": 3, "Cpp": 3, "Java": 2}
SEEDS = ["stanford", "openstax", "khanacademy"]
FORMATS = ["textbook_narrative", "textbook_academic", "scientific_article", "e-learning_module"]


def score_gate(language_score: Column, int_score: Column, default_language: float = 1.0, default_score: int = 4, least: int = 4) -> Column:
    return (F.coalesce(language_score, F.lit(default_language)) >= 0.90) & (F.coalesce(int_score, F.lit(default_score)) >= least)


def language_gate(language: Column, language_score: Column) -> Column:
    return (F.coalesce(language, F.lit("en")) == "en") & (F.coalesce(language_score, F.lit(1.0)) >= 0.90)


def web_v3_gate(language: Column, language_score: Column, int_score: Column) -> Column:
    return F.coalesce((language == "en"), F.lit(False)) & score_gate(language_score, int_score, 0.0, 0, 3)


def synthetic_gate(seed_data: Column, form: Column) -> Column:
    return F.coalesce(seed_data.isin(SEEDS) & form.isin(FORMATS), F.lit(False))


def code_gate(language: Column, license_type: Column, int_score: Column) -> Column:
    """Fails closed where a field is missing; null for a language without a threshold."""
    least = F.create_map(*(F.lit(x) for kv in CODE_MIN_SCORE.items() for x in kv))
    return F.coalesce(license_type == "permissive", F.lit(False)) & (F.coalesce(int_score, F.lit(0)) >= F.try_element_at(least, language))


def repeated_length(units: Column) -> Column:
    """Characters of all copies but the first of each unit."""
    return F.aggregate(units, F.lit(0), lambda a, x: a + F.length(x)) - F.aggregate(F.array_distinct(units), F.lit(0), lambda a, x: a + F.length(x))


def prose_units(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(c), r"[\n.!?]+", -1), tx.collapse), lambda x: F.length(x) >= 60)


def alpha_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0))


def base_reason(source: Column, identifier: Column, c: Column, tokens: Column) -> Column:
    prose = source != "code"
    return (
        F.when((source == "math") & ~tx.host_allowed(tx.url_host(identifier), MATH_HOSTS, MATH_SUFFIXES), "math_provenance_not_allowlisted")
        .when(tx.occurrences(c, "�") > F.greatest(F.lit(2.0), F.length(c) * 0.003), "replacement_character_noise")
        .when(prose & ((tokens < 128) | (F.size(alpha_words(c)) < 70)), "short_or_low_prose")
        .when(prose & c.rlike(ESSAY_MILL), "essay_homework_commercial")
        .when((source == "dclm") & c.rlike(PRESS_WIRE), "press_release_wire")
        .when(source.isin("web", "dclm") & (repeated_length(prose_units(c)) > 0.20 * F.length(c)), "repeated_prose")
    )


def web_reason(identifier: Column, c: Column, tokens: Column) -> Column:
    return (
        F.when(~tx.host_allowed(tx.url_host(identifier), WEB_HOSTS, WEB_SUFFIXES), "web_provenance_not_allowlisted")
        .when(tx.url_path(identifier).rlike(AGGREGATE_PATH), "web_aggregate_url")
        .otherwise(base_reason(F.lit("web"), identifier, c, tokens))
    )


def math_reason(source: Column, identifier: Column, c: Column, tokens: Column) -> Column:
    own = (
        F.when(tx.url_host(identifier).endswith("physicsforums.com") & F.lower(F.substring(c, 1, 1500)).contains("in summary"), "forum_autosummary")
        .when(F.substring(c, 1, 300).rlike(NAVIGATION), "math_navigation_archive")
        .when(c.rlike(LOST_NOTATION), "missing_mathematical_notation")
    )
    return F.coalesce(base_reason(source, identifier, c, tokens), own)


def general_reason(source: Column, identifier: Column, c: Column, tokens: Column) -> Column:
    own = F.when((source != "code") & (c.rlike(EXPLICIT) | c.rlike(GLOSSARY)), "explicit_sexual_or_slang_glossary")
    return F.coalesce(base_reason(source, identifier, c, tokens), own)


def narrative_reason(source: Column, identifier: Column, c: Column, tokens: Column, least_tokens: int = 2048, least_words: int = 1000) -> Column:
    words = alpha_words(c)
    n = F.size(words)
    count = lambda p: F.size(F.filter(words, p))
    found = tx.lines(c)
    paragraphs = F.filter(F.transform(F.split(F.lower(c), r"\n\s*\n", -1), tx.collapse), lambda x: F.length(x) > 100)
    own = (
        F.when(source != "narrative", "wrong_narrative_source")
        .when((tokens < least_tokens) | (n < least_words), "short_narrative")
        .when(count(lambda w: F.lower(w).isin(FUNCTION_WORDS)) < 0.07 * n, "low_english_function_word_fraction")
        .when(F.length(F.array_join(words, "")) < 0.92 * F.length(F.regexp_replace(c, r"\P{L}", "")), "non_latin_prose_fraction")
        .when(count(lambda w: (F.length(w) == 1) & ~F.lower(w).isin("a", "i")) > 0.12 * n, "fragmented_ocr_words")
        .when((F.size(found) > 100) & (F.size(F.filter(found, lambda x: F.length(x) < 35)) > 0.65 * F.size(found)), "predominantly_short_lines")
        .when(repeated_length(paragraphs) > 0.15 * F.length(c), "repeated_paragraphs")
    )
    return F.coalesce(base_reason(source, identifier, c, tokens), own)


def narrative_row_reason(source: Column, meta: Column, book_id: Column, c: Column, shard: str) -> Column:
    """Row admission from metadata; null if the row is taken."""
    url = F.coalesce(meta["url"], F.lit(""))
    book = F.regexp_extract(tx.url_path(url), r"^/ebooks/(\d+)(?:\.txt\.utf-8)?$", 1)
    known = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & tx.url_host(url).isin("www.gutenberg.org", "gutenberg.org") & (book != "") & (book == book_id)
    title = F.coalesce(meta["title"], F.lit(""))
    return (
        F.when(meta.isNull(), "missing_metadata")
        .when(F.coalesce(F.lower(tx.strip(source)) != "project gutenberg", F.lit(True)), "wrong_source")
        .when(F.coalesce(meta["language"] != "en", F.lit(True)), "not_english_metadata")
        .when(F.coalesce(F.lower(tx.strip(meta["license"])) != "public domain", F.lit(True)), "license_metadata_not_expected")
        .when(~F.coalesce(known, F.lit(False)), "provenance_url_mismatch")
        .when(~F.coalesce(meta["provenance"].startswith(shard), F.lit(False)), "wrong_source_shard")
        .when(title.rlike(OTHER_TITLE), "excluded_title_form")
        .when(~title.rlike(NARRATIVE_TITLE), "no_positive_narrative_title_cue")
        .when(F.coalesce(tx.strip(c) == "", F.lit(True)), "missing_text")
        .otherwise(tx.trim_boilerplate(c)["reason"])
    )


def caption_reason(c: Column) -> Column:
    """'pass', or the first reason against a caption."""
    words = tx.caption_words(c)
    plain = F.transform(words, lambda w: F.regexp_replace(F.lower(w), "'s$", ""))
    risky = F.lit(False)
    for term in HIGH_RISK:
        risky = risky | F.lower(c).contains(term)
    return (
        F.when((F.size(words) < 12) | (F.size(words) > 100), "word_count")
        .when(tx.ascii_fraction(c) < 0.98, "non_ascii")
        .when(c.rlike(CAPTION_EMAIL) | c.rlike(PHONE) | c.rlike(LINK), "pii_or_url_pattern")
        .when(F.arrays_overlap(plain, F.array(*(F.lit(t) for t in PERSON_TERMS))), "person_term")
        .when(risky, "high_risk_term")
        .when(F.size(F.array_distinct(plain)) < 8, "low_lexical_diversity")
        .otherwise("pass")
    )


def metadata_signals(url: Column, caption: Column, transcript: Column) -> list[tuple[str, Column]]:
    """(reason, condition) against a caption record, in order of precedence."""
    n = F.size(tx.caption_words(caption))
    both = F.concat(caption, F.lit("\n"), transcript)
    refused = F.lit(False)
    for x in REFUSALS:
        refused = refused | F.lower(both).contains(x)
    return [
        ("non_https", F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) != "https", F.lit(True))),
        ("benchmark_url_marker", F.size(tx.url_markers(url, URL_MARKERS)) > 0),
        ("caption_length", (n < 60) | (n > 350)),
        ("empty_transcript", F.size(tx.caption_words(transcript)) == 0),
        ("caption_non_ascii", tx.ascii_fraction(caption) < 0.985),
        ("email_regex", both.rlike(CAPTION_EMAIL)),
        ("phone_regex", both.rlike(PHONE)),
        ("refusal_marker", refused),
    ]


def all_signals(signals: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in signals)))


def first_signal(signals: list[tuple[str, Column]], passed: str = "pass") -> Column:
    return F.coalesce(*(F.when(c, F.lit(name)) for name, c in signals), F.lit(passed))
