"""Term lists, patterns and constants that decide results."""

# Phrases that mention arts without meaning them.
EXCLUDE_PHRASES = [r"language arts", r"\bela\b", r"martial arts", r"culinary arts", r"liberal arts", r"industrial arts", r"arts and sciences", r"arts integration coordinator", r"arts\s*\+\s*academics", r"arts and academics"]
# Terms and disciplines; the first that occurs wins.
DISCIPLINES = [
    (r"studio art", "visual art"), (r"visual art\w*", "visual art"), (r"ceramics?", "visual art"), (r"sculpture", "visual art"), (r"drawing", "visual art"), (r"painting", "visual art"),
    (r"printmaking", "visual art"), (r"ap art history", "visual art"), (r"art department chair", "visual art"), (r"digital art\w*", "media"), (r"digital media", "media"), (r"media arts?", "media"),
    (r"graphic design", "media"), (r"animation", "media"), (r"film", "media"), (r"photography", "media"), (r"theatre|theater|drama", "theatre"), (r"dance", "dance"),
    (r"choir|chorus|orchestra|band|music", "music"), (r"fine arts?", "unknown"), (r"specials", "unknown"), (r"enrichment", "unknown"), (r"\bart\b", "visual art"),
]
# Patterns of roles, schools, titles, addresses and pages.
EXCLUDED_ROLE = r"\b(choir|chorus|chorale|orchestra|orchestral|band|music|vocal|instrumental|dance|dancer|theatre|theater|drama|special\s*education|sped|special\s+needs)\b"
ARTS_SCHOOL = r"\b(arts?|visual arts?|fine arts?|design|creative|performing arts?|studio|animation|film|photography|architecture|media arts?|digital arts?|graphic arts?|art and)\b"
TITLE_JUNK = r"\b(links?|calendar|menu|click|showcase|welcome|meet\s+our|learn\s+more|stay\s+connected)\b"
STAFF_WORD = r"\b(teacher|instructor|staff|faculty)\b"
ARTS_WORD = r"\b(art|visual arts?|fine arts?)\b"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
AUTH_WALL = r"\b(staff\s+login|sign\s*in\s+required|please\s+log\s*in|employee\s+portal|single\s+sign[\s-]*on|sso\s+login)\b"
BOT_CHALLENGE = r"\b(checking\s+your\s+browser|cloudflare|are\s+you\s+a\s+robot|captcha|access\s+denied|rate\s+limit)\b"
REFUSED = (403, 429, 503)
# Addresses and texts of directories, and what tells a site system.
DIRECTORY_SLUG = r"(staff|faculty|directory|team|personnel|employee|our-school|meet-the-team|meet-our|contact|departments?|administration|teacher)"
DIRECTORY_TEXT = r"\b(staff\s+directory|faculty(\s*&\s*|\s+and\s+|\s+)?staff|faculty|our\s+staff|our\s+team|meet\s+the\s+team|meet\s+our\s+teachers?|employee\s+directory|campus\s+staff|contact\s+us|departments?|administration|fine\s+arts|specials|teacher\s+pages?|teacher\s+websites?)\b"
DEPARTMENT_PATHS = ["/fine-arts", "/visual-arts", "/departments/art", "/departments/fine-arts", "/departments/visual-arts", "/programs/fine-arts", "/programs/visual-arts", "/curriculum/fine-arts", "/arts", "/fine-arts-department"]
CMS = [
    ("finalsite", r"finalsite|fs-sticky-header|cdn\.finalsite", ["/fs/directory", "/our-school/faculty-staff"]),
    ("blackboard", r"blackboard|schoolwires|/cms/lib|/domain/\d+", ["/Page/1", "/domain/1", "/site/Default.aspx?PageID="]),
    ("edlio", r"edlio|/apps/pages/|/apps/staff/", ["/apps/staff/", "/apps/pages/"]),
    ("apptegy", r"apptegy|thrillshare|/o/[\w-]+/", ["/staff", "/page/staff-directory"]),
    ("schoolmessenger", r"schoolmessenger|campussuite", ["/staff_directory", "/departments"]),
    ("wordpress", r"wp-content|wp-json|/wp-includes/", ["/staff/", "/faculty/", "/our-team/", "/?page_id=165"]),
]
SEARCH_FORM = r"""<form\b[^>]*>(?:(?!</form>).)*?(?:type=["']search["']|name=["']q["']|role=["']search["'])"""
FORM_ACTION = r"""<form\b[^>]*\baction=["']([^"']*)["']"""
# Spelt-out addresses in a text; the strict form asks for a bracket or white space on both sides, where the other takes prose such as "look at the dotted", too.
STRICT = r"(?i)([\w._%+\-]+)(?:\s*[\[\(]\s*|\s+)at(?:\s*[\]\)]\s*|\s+)([\w.\-]+)(?:\s*[\[\(]\s*|\s+)dot(?:\s*[\]\)]\s*|\s+)([a-zA-Z]{2,})"
COMPAT = r"(?i)([\w._%+\-]+)\s*[\[\(]?\s*at\s*[\]\)]?\s*([\w.\-]+)\s*[\[\(]?\s*dot\s*[\]\)]?\s*([a-zA-Z]{2,})"
AT_ONLY = r"(?i)([\w._%+\-]+)\s*[\[\(]\s*at\s*[\]\)]\s*([\w.\-]+\.[a-zA-Z]{2,})"
# Texts of contact buttons, and addresses that are spelt out.
MESSAGE_TO = r"(?i)send\s*message\s*to\s+(.+)$"
CONTACT_TEXT = r"(?i)send\s*a?\s*message|contact\s*me|email\s*me|message\s*me|send\s*email|reach\s*out|get\s*in\s*touch|connect\s*with"
SPELT_OUT = r"(?iU)[\w._%+\-]+\s*\[?at\]?\s*[\w.\-]+\s*\[?dot\]?\s*[a-z]{2,}"
SPELT_OUT_STRICT = r"(?iU)[\w._%+\-]+(?:\s*[\[(]at[\])]\s*|\s+at\s+)[\w.\-]+(?:\s*[\[(]dot[\])]\s*|\s+dot\s+)[a-z]{2,}"
# Sources whose addresses other schools of a district may take over.
SHARED_SOURCES = ["sitemap", "cms:blackboard", "cms:finalsite", "cms:edlio", "cms:apptegy", "cms:schoolmessenger", "cms:wordpress"]
# Page numbers, letter links.
PAGE_PARAM = r"[?&](page_no|page|p)=(\d+)"
LETTER_LINK = r">\s*([A-Za-z])\s*<"
# Words of menus and notices that no person's name has.
NAV_WORDS = [
    "home", "department", "departments", "board", "agenda", "minutes", "policy", "policies", "section", "toggle", "program", "programs", "posting", "postings", "requirement", "requirements",
    "information", "service", "services", "meeting", "meetings", "special", "federal", "district", "office", "staff", "faculty", "directory", "contact", "career", "careers", "job", "jobs",
    "employment", "human", "resources", "organization", "organizations", "committee", "committees", "calendar", "handbook", "notice", "notices", "report", "reports", "budget", "safety",
    "security", "police", "transportation", "nutrition", "maintenance", "vehicle", "terminal", "bus", "academics", "elementary", "secondary", "primary", "fine", "arts", "student",
    "students", "regular", "annual", "welcome", "overview", "about", "news", "events", "choir", "choirs", "chorus", "chorale", "chorales", "orchestra", "orchestras", "ensemble", "ensembles",
    "conservatory", "conservatories", "philharmonic", "symphony", "band", "bands", "strings", "singers", "premier", "varsity", "junior", "concert", "marching", "jazz", "link", "links",
    "menu", "open", "close", "booster", "boosters", "club", "clubs", "musical", "musicals", "holiday", "holidays", "improvement", "facility", "facilities", "operation", "operations",
    "physical", "education", "schedule", "schedules", "show", "shows", "form", "forms", "resource", "resources", "gallery", "galleries", "audition", "auditions", "ticket", "tickets",
    "donate", "volunteer", "school", "schools", "middle", "showcase", "medal", "medals", "dancer", "dancers", "society", "societies", "honor", "honors", "national", "instructional",
    "material", "materials", "month", "months", "world", "language", "languages", "stay", "connected", "soup", "cans",
]
# Words of names, and codes of the registry.
ABBREVIATIONS = {"isd": "independent school district", "usd": "unified school district", "csd": "consolidated school district", "elem": "elementary", "jr": "junior", "sr": "senior"}
STOPWORDS = ["the", "of", "at", "and", "a", "an", "for"]
KEEP_UPPER = ["II", "III", "IV", "V", "VI", "HS", "MS", "ES", "PK", "DAEP", "ISD", "CISD", "USD", "LEA", "NCES"]
OPEN_STATUSES = ["Open", "New", "1", "3", ""]
MISSING_TOKENS = ["†", "–", "‡", "&dagger;", "&ndash;", "&Dagger;", "N", "M", ""]
MISSED = ["NO_DIRECTORY_FOUND", "TIMEOUT", "BLOCKED", "BLOCKED_BY_SITE"]
LEGACY_MISSED = ["no_directory_found", "timeout", "robots_blocked", "no_url"]
ALIASES = {
    "nces school id": "NCESSCH", "school name": "SCH_NAME", "district": "LEA_NAME", "city": "LCITY", "state": "ST", "status": "SY_STATUS_TEXT", "type": "TYPE", "stabr": "ST", "school level": "SCHOOL_LEVEL",
    "school_level": "SCHOOL_LEVEL", "level": "SCHOOL_LEVEL", "lowest grade offered": "GSLO", "highest grade offered": "GSHI", "grade span low": "GSLO", "grade span high": "GSHI", "gslo": "GSLO", "gshi": "GSHI",
}
HEADER_CELLS = ["nces school id", "ncessch", "school id"]
FUZZY = 0.82
