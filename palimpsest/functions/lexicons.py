"""Word lists, patterns and constants that decide what counts as personal data."""

# ---- fixed values, given by the task: they decide results, so they are stated as they are. The word lists are sets, compared without
# ---- regard to case; their order is free (alphabetical here), and titles are sorted by length before they become a pattern ----
ROLE_TITLES = "CEO|CFO|COO|CS|Chairman|Chief Executive Officer|Chief Financial Officer|Chief Operating Officer|Company Secretary|Compliance Officer|Contact Person|Director|Executive Director|Founder|General Manager|Independent Director|Joint Managing Director|Manager|Managing Director|Non[- ]Executive Director|Officer|Partner|President|Principal|Promoter|Proprietor|Senior Manager|Technical Director|Treasurer|Trustee|Vice President|Whole[- ]?time Director".split("|")
PUBLIC_BODIES = "bse|bse limited|cdsl|companies act|government of india|gst|high court|icai|ifrs|income tax department|ind as|india|mca|ministry of corporate affairs|national stock exchange of india limited|npci|nsdl|nse|rbi|registrar of companies|reserve bank of india|roc|sebi|securities and exchange board of india|supreme court|the companies act|us gaap".split("|")
COMPANY_SUFFIXES = "associates|bank|capital|co|company|corp|corporation|enterprises|foundation|gmbh|group|holdings|inc|incorporated|industries|limited|llp|ltd|partners|plc|private|pvt|securities|services|solutions|technologies|trust".split("|")
STRUCTURE_WORDS = "act|annexure|appendix|build|chapter|department|details|directory|division|document|form|heading|information|list|note|notes|overview|page|policy|prospectus|record|records|report|schedule|section|software|statement|summary|table|version".split("|")
DOMAIN_TERMS = "account|act|agent|agents|allotment|allottee|amount|anchor|auditor|auditors|bid|bidder|bidders|board|cap|capital|circular|committee|date|depository|equity|escrow|facility|floor|form|fund|funds|gross|institutional|intermediaries|intermediary|investor|investors|material|mechanism|meeting|net|offer|office|period|policy|portion|price|proceeds|promoter|prospectus|registrar|regulation|regulations|resolution|retail|rules|scheme|share|shareholder|shareholders|shares|slip|syndicate|underwriter|underwriters|working".split("|")
PERSON_NOISE = "branch|committee|department|division|fund|group|industrial|key|management|managerial|park|personnel|team|trust".split("|")
LEADING_NOISE = "a|an|and|auditor|auditors|banker|bankers|being|by|companies|company|counsel|erstwhile|formerly|from|manager|managers|member|members|namely|of|our|registrar|sponsor|statutory|the|to|viz|with".split("|")
PLACE_WORDS = "apartment|bank|block|broker|building|campus|center|centre|chambers|colony|complex|department|division|estate|floor|hall|house|lane|marg|nagar|park|plot|road|society|station|street|tower|wing".split("|")
TAIL_STOP_WORDS = "account|amount|attn|batch|case|cin|claim|code|company|contact|corporate|customer|date|dated|din|docket|e-mail|email|employee|fax|file|gst|id|invoice|mobile|no|number|order|pan|phone|policy|receipt|ref|reference|registrar|registration|request|sebi|serial|status|tel|telephone|ticket|url|website".split("|")
INITIALISMS = {"cs": "company secretary", "ceo": "chief executive officer", "cfo": "chief financial officer", "coo": "chief operating officer", "md": "managing director"}
PRIORITY = {"EMAIL": 100, "SSN": 95, "CREDIT_CARD": 90, "IP_ADDRESS": 85, "PHONE": 80, "PAN": 75, "DIN": 70, "DOB": 65, "ADDRESS": 40, "PERSON": 30, "COMPANY": 20}

EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?<![\w.])\+\s?\d{1,3}[\s-]?[\d(][\d\s()-]{7,16}\d(?!\d)(?!\.\d)"
SSN = r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b"
CREDIT_CARD = r"\b(?:\d[ -]?){12,18}\d\b"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP_ADDRESS = rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"
PAN = r"\b[A-Z]{5}\d{4}[A-Z]\b"
DIN = r"((?i:\bDIN\b)[:\s]*\b)(\d{8})\b"
MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
DATES = (rf"\b{MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b", rf"\b\d{{1,2}}\s+{MONTH}\s+\d{{4}}\b")
BIRTH_GATE = r"(?i)\b(date\s+of\s+birth|d\.?o\.?b\.?|born\s+on|born|birth\s*date)\b"
GUARDS = {
    "SSN": r"(?i)\b(invoice|order|ticket|reference|ref|receipt|docket|case|file|account|policy|claim)\b[\s:#]*(?:no\.?|number|id)?[\s:#]*$",
    "CREDIT_CARD": r"(?i)\b(ticket|reference|ref|order|invoice|share|shares|unit|units|quantity|qty|account|folio|transaction|txn|id)\b[\s:#]*(?:no\.?|number|id)?[\s:#]*$",
    "IP_ADDRESS": r"(?i)\b(version|build|release|ver|v|revision|clause|section|rule|regulation)\b[\s:.#]*$",
}
LEGAL_FORM = r"(?:Private\s+Limited|Pvt\.?\s+Ltd\.?|Limited|Ltd\.?|LLP|L\.L\.P\.|Incorporated|Inc\.?|Corporation|Corp\.?|PLC|GmbH|N\.V\.|S\.A\.|Family\s+Trust|Trust|Bank|Securities|Technologies|Industries)"
COMPANY = rf"\b(?:(?:[A-Z][A-Za-z.'-]*|&),?\s+){{1,6}}{LEGAL_FORM}\b"
POSTCODE = r"(?:\b\d{3}\s?\d{3}\b|\b\d{5}(?:-\d{4})?\b|\b[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b|\b[A-Z]\d[A-Z]\s?\d[A-Z]\d\b)"
ADDRESS = rf"([A-Z0-9][^\n]{{10,180}}?(?:,\s*|\s+[–—-]\s*|\s+)(?:[A-Z]{{2}}\.?\s+)?)({POSTCODE})"
TAIL_TOKEN = r"^(\s*,?\s*([A-Z][A-Za-z.]+))"
NOT_POSTCODE = (
    r"(?i)\b(order|ticket|invoice|request|reference|ref|receipt|docket|code|id|no|number|acct|account|claim|policy)\b[\s:#]*[-–—]?\s*$",
    r"\b[A-Z]{2,5}-$",
    r"(?i)\b(registration|review|licence|license|certificate|reference|registration\s+no|number|no\.)\s*[:\-]?\s*$",
)
ADDRESS_LABEL = r"(?i)^\s*(registered office|corporate office|residence|address|office|located at|situated at|registered address)\s*[:\-]?\s*"
NON_ADDRESS_LINE = r"(?i)^\s*(firm|peer|sebi|cin|din|registration|telephone|tel|fax|email|e-mail|website|url|contact|investor|changes|company registration|corporate identity|registration number|address of)\b"
LABELLED_FIELD = r"^\s*[A-Za-z][A-Za-z0-9 /&.\-]{1,28}:"
CONTACT_PERSON = r"(?i)\bcontact\s+person\s*:?\s*(.+)"
CONTACT_CUT = r"(?i)\b(website|email|e-mail|telephone|tel|sebi|cin|fax)\b"
NAME_SEPARATOR = r"\s*(?:/|,|\band\b)\s*"
ADDRESS_LINES = ("Exampleton - 411 001", "Example State, India", "12 Example Road, Sector 4", "Example City - 400 002", "Example District, India")
COMPANY_FORMS = ("Technologies Ltd.", "Industries Limited", "Solutions Private Limited", "Enterprises Ltd.", "Manufacturing Limited", "Holdings Private Limited")
LOOK_BACK, ROLE_BEFORE, ROLE_AFTER = 40, 28, 60
TAIL_TOKENS, MAX_LINE, MAX_BLOCK, BLOCK_HEAD, MIN_FRAGMENT, MIN_TOUCHED = 3, 120, 5, 40, 3, 2
MIN_NER, MIN_PROPAGATED, SHORT_ADDRESS, PHONE_DIGITS, SIMILAR = 3, 6, 30, 8, 0.8
CARRIER_BEFORE, CARRIER_AFTER, CARRIER_MAX = "Contact person: ", ".", 60
# ---- end of fixed values ----

#: Names for surrogates: ours, combined by ordinal.
FIRST_NAMES = "Asha Bela Charu Devan Esha Farid Gita Hari Ila Jeet Kiran Lata Mohan Nila Om Priti Qadir Rekha Samar Tara".split()
LAST_NAMES = "Amberley Brookfen Calder Dunmore Elstow Fairwick Glenholt Harrowby Inglesham Jessop Kelby Lorne Marsden Norwell Oakham".split()


def any_word(words) -> str:
    """A pattern for any of the words, whole, in any case."""
    return r"(?i)\b(?:" + "|".join(words) + r")\b"


_TITLE = "(?:" + "|".join(sorted(ROLE_TITLES, key=lambda t: (-len(t), t))) + ")"
ROLE = rf"(?i)\b({_TITLE}(?:\s*(?:and|&|/)\s*{_TITLE})?)\b"
