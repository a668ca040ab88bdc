"""Rule tables and dimension data.

Everything in the block below is a FIXED VALUE that must equal the source system's for the results
to match: names, URLs, keyword lists (order matters where noted), thresholds and lookup tables.
They are stated as plain data, in their natural order; the operators turn them into Catalyst
expressions or small broadcast dimension frames.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------
# FIXED VALUES (must equal the source system's)
# ---------------------------------------------------------------------------------------------

# Source dimension: research councils (id, name, url, funding_url), in rule order.
COUNCILS = [
    ("ahrc", "Arts and Humanities Research Council", "https://www.ukri.org/councils/ahrc/",
     "https://www.ukri.org/opportunity/?filter_council=ahrc"),
    ("bbsrc", "Biotechnology and Biological Sciences Research Council", "https://www.ukri.org/councils/bbsrc/",
     "https://www.ukri.org/opportunity/?filter_council=bbsrc"),
    ("esrc", "Economic and Social Research Council", "https://www.ukri.org/councils/esrc/",
     "https://www.ukri.org/opportunity/?filter_council=esrc"),
    ("epsrc", "Engineering and Physical Sciences Research Council", "https://www.ukri.org/councils/epsrc/",
     "https://www.ukri.org/opportunity/?filter_council=epsrc"),
    ("mrc", "Medical Research Council", "https://www.ukri.org/councils/mrc/",
     "https://www.ukri.org/opportunity/?filter_council=mrc"),
    ("nerc", "Natural Environment Research Council", "https://www.ukri.org/councils/nerc/",
     "https://www.ukri.org/opportunity/?filter_council=nerc"),
    ("stfc", "Science and Technology Facilities Council", "https://www.ukri.org/councils/stfc/",
     "https://www.ukri.org/opportunity/?filter_council=stfc"),
    ("innovate_uk", "Innovate UK", "https://www.ukri.org/councils/innovate-uk/",
     "https://www.ukri.org/opportunity/?filter_council=innovate-uk"),
    ("research_england", "Research England", "https://www.ukri.org/councils/research-england/",
     "https://www.ukri.org/opportunity/?filter_council=research-england"),
]

# Source dimension: academies (id, name, base_url, funding_url, disciplines).
ACADEMIES = [
    ("royal_society", "The Royal Society", "https://royalsociety.org",
     "https://royalsociety.org/grants-schemes-awards/", ["Natural Sciences", "Engineering", "Mathematics"]),
    ("british_academy", "The British Academy", "https://www.thebritishacademy.ac.uk",
     "https://www.thebritishacademy.ac.uk/funding/", ["Humanities", "Social Sciences"]),
    ("royal_academy_engineering", "The Royal Academy of Engineering", "https://raeng.org.uk",
     "https://www.raeng.org.uk/programmes-and-prizes", ["Engineering", "Technology"]),
    ("academy_medical_sciences", "The Academy of Medical Sciences", "https://acmedsci.ac.uk",
     "https://acmedsci.ac.uk/grants-and-schemes", ["Medical Sciences", "Biomedical Research"]),
]

# Source dimension: foundations (id, name, base_url, funding_url, focus_areas, description).
FOUNDATIONS = [
    ("wellcome_trust", "The Wellcome Trust", "https://wellcome.org", "https://wellcome.org/grant-funding/schemes",
     ["Biomedical Research", "Medical Humanities", "Global Health"],
     "Global charitable foundation dedicated to improving health"),
    ("leverhulme_trust", "The Leverhulme Trust", "https://www.leverhulme.ac.uk", "https://www.leverhulme.ac.uk/funding",
     ["All Academic Disciplines"],
     "Supports original, curiosity-driven research across all disciplines"),
    ("nuffield_foundation", "Nuffield Foundation", "https://www.nuffieldfoundation.org",
     "https://www.nuffieldfoundation.org/funding/", ["Education", "Justice", "Welfare"],
     "Funds research and innovation in education, justice, and welfare"),
    ("wolfson_foundation", "The Wolfson Foundation", "https://www.wolfson.org.uk", "https://www.wolfson.org.uk/funding",
     ["Science", "Medicine", "Arts", "Humanities"],
     "Awards grants for excellence in science, medicine, arts and humanities"),
]

# Source classification keywords (EX-16), first source in this order wins; default 'ahrc'.
COUNCIL_KEYWORDS = [
    ("ahrc", ["arts", "humanities", "ahrc"]),
    ("bbsrc", ["biotechnology", "biological", "bbsrc"]),
    ("esrc", ["economic", "social", "esrc"]),
    ("epsrc", ["engineering", "physical", "epsrc"]),
    ("mrc", ["medical", "health", "mrc"]),
    ("nerc", ["environment", "natural", "nerc"]),
    ("stfc", ["science", "technology", "facilities", "stfc"]),
    ("innovate_uk", ["innovation", "business", "innovate"]),
    ("research_england", ["research-england"]),
]
DEFAULT_COUNCIL = "ahrc"

# Tag keywords (EX-17): keyword -> tag, appended in this order.
TAG_KEYWORDS = [
    ("fellowship", "fellowship"),
    ("grant", "grant"),
    ("early career", "early-career"),
    ("postdoc", "postdoctoral"),
    ("innovation", "innovation"),
    ("collaboration", "collaboration"),
    ("international", "international"),
    ("equipment", "equipment"),
    ("training", "training"),
    ("network", "networking"),
]

# Career stage from page text (EX-6): first rule whose any keyword occurs wins.
CAREER_STAGE_RULES = [
    ("Early Career", ["early career", "postdoc"]),
    ("Senior", ["senior", "professor"]),
    ("Mid Career", ["fellowship"]),
]
DEFAULT_CAREER_STAGE = "All Stages"

# Success rate by career stage (SC-5); unknown stage -> DEFAULT_SUCCESS_RATE.
SUCCESS_RATES = {"Early Career": "15%", "Mid Career": "20%", "Senior": "25%", "All Stages": "18%"}
DEFAULT_SUCCESS_RATE = "18%"

# Priority level thresholds (SC-3 variant A, SC-4 variant B): (minimum max-amount, level), highest first.
PRIORITY_A = [(500000, "Very High"), (200000, "High"), (50000, "Medium")]
PRIORITY_B = [(1000000, "Very High"), (500000, "High"), (200000, "Medium")]
PRIORITY_FLOOR = "Low"
UKRI_PRIORITY = "High"

# Competition level from success-rate percent (SC-6): (upper bound inclusive, level).
COMPETITION_LEVELS = [(10, "Extremely Competitive"), (20, "Very Competitive"), (30, "Competitive")]
COMPETITION_FLOOR = "Moderately Competitive"

# Standard requirements by career stage (SC-7): variant A (academies) and variant B (foundations).
REQUIREMENTS_A = {
    "Early Career": ["PhD completed within 8 years", "Demonstrated research excellence", "UK-based position or offer"],
    "Mid Career": ["Established research track record", "Independent research experience", "UK-based position"],
    "Senior": ["Senior academic position", "Significant research achievements", "Leadership experience"],
    "All Stages": ["Employed at eligible UK institution", "Research proposal in scope"],
}
REQUIREMENTS_B = {
    "Early Career": ["PhD or equivalent qualification", "Within 8 years of PhD completion",
                     "Demonstrated research potential"],
    "Mid Career": ["Established research track record", "Independent research experience",
                   "Institutional affiliation"],
    "Senior": ["Senior academic position", "Significant research achievements", "Leadership in field"],
    "All Stages": ["Employed at eligible institution", "Research proposal within scope",
                   "Demonstrated research capability"],
}

# Funding covers by title keyword (SC-8), first match wins, else the default list.
COVERS_RULES = [
    ("fellowship", ["Salary", "Research expenses", "Equipment", "Travel", "Training"]),
    ("training", ["Stipend", "Training costs", "Travel", "Accommodation"]),
    ("equipment", ["Equipment", "Installation", "Maintenance", "Training"]),
]
COVERS_DEFAULT = ["Research costs", "Equipment", "Travel", "Consumables"]
COVERS_UKRI = ["Research costs", "Equipment", "Travel"]
COVERS_ACADEMIES = ["Salary", "Research expenses", "Equipment", "Travel"]

# Contact e-mail by source base URL (SC-9), default ''.
FOUNDATION_EMAILS = [
    ("https://wellcome.org", "grantsenquiries@wellcome.org"),
    ("https://www.leverhulme.ac.uk", "enquiries@leverhulme.ac.uk"),
    ("https://www.nuffieldfoundation.org", "info@nuffieldfoundation.org"),
    ("https://www.wolfson.org.uk", "info@wolfson.org.uk"),
]

# Record validation (FL-2 strict, FL-3 database check).
REQUIRED_STRICT = ["id", "title", "organization", "category", "description", "eligibility", "funding_details",
                   "application"]
REQUIRED_DATABASE = ["id", "title", "organization", "category", "description"]

# Source run order (RL-1).
SOURCE_ORDER = ["ukri", "academies", "foundations"]

# Link extraction (EX-14): opportunity-href pattern and the substrings that disqualify a link.
OPPORTUNITY_HREF = r"/opportunity/[^/?]+/?$"
LINK_EXCLUDES = ["filter_", "sort_", "page=", "?"]

# Title selectors (EX-2) and description selectors (EX-4), in priority order.
TITLE_SELECTORS = ["h1.page-title", "h1", ".opportunity-title", ".page-header h1"]
DESCRIPTION_SELECTORS = [".opportunity-summary", ".page-summary", ".lead", ".intro-text"]

# Email pattern (EX-13).
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"

# Month names for the 'D MonthName YYYY' deadline pattern (EX-10).
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
          "November", "December"]

# Deadline defaults (EX-11): days after the crawl date; default frequency.
DEFAULT_DEADLINE_DAYS = 90
DEFAULT_NEXT_DEADLINE_DAYS = 365
DEFAULT_FREQUENCY = "Annual"

# Dashboard thresholds: closing-soon window (days), urgent window (days), value-band and verdict ratios.
CLOSING_SOON_DAYS = 30
URGENT_DAYS = 7
VERDICT_HIGH_SHARE = 0.3
VERDICT_MEDIUM_SHARE = 0.4
VERDICTS = [
    ("High", "Many high-value, competitive opportunities"),
    ("Medium", "Mix of competitive and accessible opportunities"),
    ("Low", "Generally accessible opportunities"),
]
DISPLAY_PENCE_ABOVE = 1000000

# Main source (EN-2): site of its pages, key info of its records (SC-10).
COUNCIL_SITE = "https://www.ukri.org"
COUNCIL_COMPETITION = "Very Competitive"
COUNCIL_SUCCESS_RATE = "N/A"
FUNDING_FINDER = "funding finder"

# Cards of a foundation's pages (EX-18, EX-19, EX-20): source, kind of card, tag, frequency where the card has none.
SCHEME_PAGES = [
    ("wellcome_trust", "teaser", "wellcome-trust", "N/A"),
    ("leverhulme_trust", "block", "leverhulme-trust", "N/A"),
    ("nuffield_foundation", "dated", "nuffield-foundation", "Annual"),
]

# What a failing row stops (RL-5): itself, or all rows of its source.
FAILURE_SCOPE = {"ukri": "record", "academies": "source", "foundations": "source"}

# Labelled blocks (EX-19): where a page's text is split, the block (title, For, Duration, Frequency, Value), its
# deadline as the rest of the line or as one character, and the duration and value inside a block.
BLOCK_SPLIT = r"\n\n(?=[A-Z][a-z])"
BLOCK_HEAD = (r"(?s)([A-Za-z0-9\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000&,/-]+?)\nFor\s(.+?)\n"
              r"(?:Duration:\s(.+?)\n)?(?:Frequency:\s(.+?)\n)?(?:Value:\s(.+?)\n)?")
BLOCK_DEADLINE_LINE = r"(?:Deadline/Opening:\s([^\n]+))?"
BLOCK_DEADLINE_LAZY = r"(?:Deadline/Opening:\s(.+?))?"
BLOCK_DURATION_RANGE = r"(\d+)(?: to (\d+))?\s*years"
BLOCK_VALUE = r"(?i)£([\d,.]+)(?:m| million)?(?: to £([\d,.]+)(?:m| million)?)?"
