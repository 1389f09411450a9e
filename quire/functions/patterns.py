"""Word lists and patterns that classification results depend on, EN and DE.

All are matched against lower-cased text unless a rule says otherwise.
"""

# fixed values: titles of front and back matter
TOC_TITLES = (
    r"^(table of contents|contents|toc)$",
    r"^inhalts?(verzeichnis)?$",
    r"^inhalt$",
    r"^übersicht$",
)
COPYRIGHT_TITLES = (
    r"^copyright",
    r"^legal\s*(notice|info)?$",
    r"^(impressum|imprint)$",
    r"^rights?\s*(info|notice|page)?$",
    r"^(urheberrecht|rechtshinweis)$",
    r"^colophon$",
)
BY_AUTHOR_TITLES = (r"^(books?|novels?|works?|bücher|romane|werke)\s+(by|von)\s+",)
#: Meant for capitalised titles; it meets lower-cased ones and so never fires. Used only in "fixed" mode, on the title as written.
BY_NAME_TITLE = r"^([Bb]y|[Vv]on)\s+[A-ZÄÖÜ][\p{L}]+(\s+[A-ZÄÖÜ][\p{L}]+){0,3}$"
FOREWORD_TITLES = (
    r"^(foreword|preface|prologue|preamble)$",
    r"^(vorwort|einleitung|einführung|geleitwort|prolog)$",
    r"^(author'?s?\s*note|note\s*(from|by)\s*(the\s*)?author)$",
    r"^(anmerkung(en)?\s*de[sr]\s*autors?)$",
    r"^introduction$",
)
DEDICATION_TITLES = (
    r"^(dedication|widmung|hingabe)$",
    r"^(für|for)\s+",
    r"^to\s+(my|the)\s+",
    r"^in\s+memory\s+of",
)
EPIGRAPH_TITLES = (r"^epigraph$", r"^motto$", r"^(zitat|quote)$")
PRAISE_TITLES = (
    r"^praise\s*(for\s*)?",
    r"^(reviews?|acclaim)$",
    r"^(pressestimmen|stimmen\s*zum?\s*(buch|roman))",
    r"^(what\s+(people|critics|readers)\s+are\s+saying)",
)
ABOUT_BOOK_TITLES = (
    r"^about\s*(this\s*)?(the\s*)?book",
    r"^über\s*(dieses|das)\s*buch",
    r"^(klappentext|buchbeschreibung)$",
    r"^(synopsis|zusammenfassung)$",
    r"^(book|buch)\s*description$",
)
ABOUT_AUTHOR_TITLES = (
    r"^about\s*(the\s*)?author",
    r"^about\s*(me|the\s*writer)",
    r"^meet\s*(the\s*)?author",
    r"^über\s*(den|die|dem?)\s*autor",
    r"^(der|die)\s*autor(in)?$",
    r"^(author|autor(in)?)\s*(bio(graphy|grafie)?)?$",
    r"^(biographical\s*note|biographische?r?\s*(anmerkung|hinweis))",
    r"^vita$",
    r"^zur?\s*person",
)
ACKNOWLEDGEMENT_TITLES = (
    r"^(acknowledgements?|acknowledgments?)$",
    r"^(danksagung|dank|dankeswort)$",
    r"^(thanks|thank\s*you)$",
)
PREVIEW_TITLES = (
    r"leseprobe",
    r"^(preview|excerpt|sneak\s*peek|sample)",
    r"^(auszug|textprobe|vorabdruck)",
    r"^(read\s*(an?\s*)?excerpt)",
    r"^(lesen\s*sie\s*(auch|mehr))",
)
ALSO_BY_TITLES = (
    r"^also\s*by",
    r"^(other|more)\s*(books?\s*)?by",
    r"^(weitere\s*)?(bücher|werke|romane|titel)\s*(von|des|der)",
    r"^(vom\s*selben|von\s*der?\s*(gleichen|selben))\s*autor",
    r"^(books?\s*by\s*(this|the)\s*author)",
    r"^bibliography$",
    r"^(empfehlung|buchempfehlung)",
    r"^(weitere\s*)?veröffentlichung",
)
NEWSLETTER_TITLES = (
    r"^(sign\s*up|signup|subscribe|newsletter)",
    r"^(discover\s+(your\s+next|more))",
    r"^(what'?s\s+next\s+on)",
    r"^(your\s+reading\s+list)",
    r"^(get\s+personalized|get\s+updates)",
    r"^(entdecken\s+sie\s+(ihre|ihren|mehr))",
    r"^(was\s+kommt\s+als\s+nächstes)",
    r"^(melden\s+sie\s+sich\s+(jetzt\s+)?an)",
    r"^(erhalten\s+sie\s+(personalisierte|aktuelle))",
    r"^(ihre\s+leseliste)",
)
GLOSSARY_TITLES = (
    r"^(glossary|glossar)$",
    r"^(begriffserklärung|wörterverzeichnis)$",
    r"^(abkürzungsverzeichnis|abbreviations?)$",
)
INDEX_TITLES = (r"^(index|register|stichwortverzeichnis|namensverzeichnis)$",)
BIBLIOGRAPHY_TITLES = (r"^(bibliograph(y|ie)|references|quellen(verzeichnis)?|literatur(verzeichnis)?)$",)
COVER_TITLES = (
    r"^cover$",
    r"^(title\s*page|titelseite|titelblatt)$",
    r"^(half\s*title|schmutztitel)$",
    r"^(front\s*matter|vorsatz)$",
    r"^frontispiece$",
)
NUMBERED_TITLE = r"^(chapter|kapitel)\s*\d+\s*[:\-–—.]\s*"

# fixed values: file names that are skipped, in order of precedence
SKIPPED_FILES = (
    ("cover page", r"^cover\.(x?html?|xhtml)$"),
    ("title page", r"^title(page)?\.(x?html?|xhtml)$"),
    ("table of contents", r"^(toc|contents|table.?of.?contents)\.(x?html?|xhtml)$"),
    ("navigation", r"^nav\."),
    ("copyright", r"^(copyright|legal|rights|imprint|impressum)\.(x?html?|xhtml)$"),
    ("dedication", r"^(dedication|widmung)\.(x?html?|xhtml)$"),
    ("colophon", r"^colophon\.(x?html?|xhtml)$"),
    ("about the author", r"^(about.?(the.?)?author|about.?me|biography|biografie|vita)\.(x?html?|xhtml)$"),
    ("acknowledgements", r"^(acknowledg(e)?ments?|danksagung)\.(x?html?|xhtml)$"),
    ("publisher promo", r"^(also-?by|other-?books|by-?the-?author|bm\d+|ata|newsletter|signup|promo|prh-?ad)\.(x?html?|xhtml)$"),
)

# fixed values: where an archive names its package document, and the package's metadata, manifest (both orders of attributes) and reading order
CONTAINER_FILE = "META-INF/container.xml"
PACKAGE_PATH = r'full-path="([^"]+)"'
PACKAGE_ELEMENT = r"<dc:{}[^>]*>([^<]+)<\/dc:{}>"
MANIFEST_ID_FIRST = r'<item\s[^>]*?id="([^"]+)"[^>]*?href="([^"]+)"[^>]*>'
MANIFEST_HREF_FIRST = r'<item\s[^>]*?href="([^"]+)"[^>]*?id="([^"]+)"[^>]*>'
SPINE_ITEM = r'<itemref[^>]+idref="([^"]+)"[^>]*>'
CHAPTER_SUFFIXES = (".html", ".xhtml", ".htm")
NO_CHAPTER_PARTS = ("nav.", "toc.")

# fixed values: lines that look like entries of a table of contents (any case)
TOC_LINES = (
    r"^(chapter|kapitel|part|teil)\s+[ivxlcdm\d]+",
    r"^[ivxlcdm]+\.\s+\S",
    r"^\d+\.?\s+\S",
    r"\s+\d{1,4}\s*$",
    r"^\S.{0,60}\.{3,}",
    r"^(prologue|epilogue|foreword|preface|introduction|acknowledgements?|appendix|index|prolog|epilog|vorwort|einleitung|anhang|register)$",
)

# fixed values: marketing phrases; each counts once
PROMO_SIGNALS = (
    r"discover\s+(your\s+next|more|what)",
    r"what'?s\s+next\s+on",
    r"reading\s+list",
    r"sign\s+up\s+(now|today|for)",
    r"personalized\s+(book|picks|recommend)",
    r"get\s+(personalized|updates|news)",
    r"next\s+great\s+read",
    r"newsletter",
    r"subscribe",
    r"entdecken\s+sie\s+(ihre|ihren|mehr)",
    r"was\s+kommt\s+als\s+nächstes",
    r"(ihre|deine)\s+leseliste",
    r"melden\s+sie\s+sich\s+(jetzt\s+)?an",
    r"personalisierte?\s+(buch|empfehlung)",
    r"erhalten\s+sie\s+(personalisierte|aktuelle)",
    r"großartige\s+lektüre",
    r"tolle\s+lektüre",
)

# fixed values: shapes of lines in lists of books
BY_SOMEONE = r"^(by|von)\s+\p{L}"
SENTENCE_BREAK = r"\.\s+[A-ZÄÖÜ]"
TITLE_CASE_LINE = r"^[A-ZÄÖÜ][\p{L}\s'’:,-]+$"
BOOK_LINE_PARTS = ("isbn", "€", "$")
BOOK_LINES = (
    r"\d{3}-\d",
    r"^(auch\s*(als|bei|von|erhältlich)|available|erhältlich|erscheint|erschienen)",
    r"^(taschenbuch|hardcover|paperback|ebook|e-book|hörbuch|audiobook)",
)

# fixed values: phrases of previews, rights pages, biographies, dedications, epigraphs, thanks, editors' forewords
PREVIEW_PHRASES = ("leseprobe", "lesen sie auch", "read an excerpt", "sneak peek", "coming soon", "erscheint demnächst", "preview of", "auszug aus", "vorabdruck")
FIRST_CHAPTER = r"^(kapitel|chapter)\s*1\b"
SHORT_RIGHTS_PHRASES = ("all rights reserved", "alle rechte vorbehalten", "isbn", "published by", "copyright ©", "copyright (c)")
RIGHTS_SIGNALS = (
    r"all rights reserved",
    r"alle rechte vorbehalten",
    r"isbn",
    r"copyright\s*[©(]",
    r"published by|verlag",
    r"\b(20\d{2}|19\d{2})\b.*publish",
)
BIOGRAPHY_SIGNALS = (
    r"\b(is the author of|is the bestselling author|is the (award.?winning|#1|new york times)\s+\w+\s*author|ist (der )?autor(in)?)",
    r"\b(lives in|lebt in|resides in|wohnt in)\b",
    r"\b(was born|born in|geboren (in|am)|is a graduate of|studierte|graduated from)\b",
    r"\b(her|his|ihr|sein)\s+(previous|first|latest|new|next|nächste[sr]?|letzte[sr]?)\s+(book|novel|roman|buch)",
    r"\bvisit\s+(his|her|their|the\s+author'?s)\s+(website|online|at)",
    r"\b(follow\s+(him|her|them|the\s+author)\s+on|twitter\.com|@\w+)",
    r"\b(he|she|they|er|sie)\s+(currently\s+)?(lives|teaches|works|writes)\b",
)
DEDICATION_LINES = (
    r"^(for\s+my\s+|for\s+the\s+|to\s+my\s+|to\s+the\s+|in\s+memory\s+of|dedicated\s+to|für\s+|for\s+\w+\s*,)",
    r"^in\s+loving\s+memory",
)
#: Needs a capital and meets a lower-cased line, so it never fires. Used only in "fixed" mode, on the line as written.
DEDICATION_NAME_LINE = r"^([Ff]or|[Ff]ür)\s+[\p{Lu}]\p{L}+\s*\.?$"
ATTRIBUTION = r"[\n\s](—|–|--)\s*[A-ZÄÖÜ][^\n]{2,50}\s*(?:\n|\r|$)"
QUOTED = r"""["“”„‘’«»].+["“”„‘’«»]"""
THANKS = r"\b(i\s+would\s+like\s+to\s+thank|i\s+want\s+to\s+thank|my\s+thanks\s+(go|to)|thanks\s+to|i('| a)m\s+grateful\s+to|ich\s+möchte\s+(mich\s+)?bedanken|mein\s+dank\s+(geht|gilt)|danke?\s+an)"
EDITOR_OPENINGS = (r"\bthe\s+author('s)?\b", r"\bin\s+this\s+(book|volume|work)")
EDITOR_CLOSING = r"\b(editor|translator|herausgeber|übersetzer)\b"

# fixed values: named entities in the order in which they are replaced
ENTITIES = (
    ("&nbsp;", " "), ("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
    ("&mdash;", "—"), ("&ndash;", "–"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"),
    ("&hellip;", "…"), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&deg;", "°"), ("&times;", "×"), ("&divide;", "÷"),
    ("&euro;", "€"), ("&pound;", "£"), ("&yen;", "¥"), ("&sect;", "§"), ("&para;", "¶"), ("&bull;", "•"),
    ("&ensp;", "\u2002"), ("&emsp;", "\u2003"), ("&thinsp;", "\u2009"), ("&shy;", "\u00ad"),
)

# fixed values: markup
BLOCK_TAGS = r"<\/?(p|div|h[1-6]|br|li|blockquote|section|article|tr)[^>]*\/?>"
HEADING = r"<h[1-3][^>]*>([\s\S]*?)<\/h[1-3]>"
TITLE_TAG = r"<title[^>]*>([\s\S]*?)<\/title>"
CLASS_ATTRIBUTE = r"<(?:body|section|div|p)[^>]*class\s*=\s*[\"']([^\"']+)[\"'][^>]*>"
TYPE_ATTRIBUTE = r"epub:type\s*=\s*[\"']([^\"']+)[\"']"
GENERIC_TITLE = r"^(untitled|document|page\s*\d+)$"

# fixed values: titles that class names, semantic types and file names stand for
CLASS_TITLES = (
    ("Table of Contents", r"^(toc|contents|table-?of-?contents)$"),
    ("Dedication", r"^(dedication|widmung)$"),
    ("Copyright", r"^(copyright|legal|imprint|impressum|colophon)$"),
    ("Foreword", r"^foreword$"),
    ("Preface", r"^preface$"),
    ("Prologue", r"^prologue$"),
    ("Introduction", r"^introduction$"),
    ("Acknowledgements", r"^(acknowledgements?|acknowledgments?|danksagung)$"),
    ("About the Author", r"^(about-?(the-?)?author|author-?bio|biography)$"),
    ("Cover", r"^(cover|title-?page|half-?title)$"),
    ("Epigraph", r"^(epigraph|motto)$"),
    ("Praise", r"^(praise|reviews?|blurbs?)$"),
)
TYPE_TITLES = (
    ("Table of Contents", r"\btoc\b"),
    ("Dedication", r"\bdedication\b"),
    ("Copyright", r"\bcopyright-page\b"),
    ("Foreword", r"\bforeword\b"),
    ("Preface", r"\bpreface\b"),
    ("Prologue", r"\bprologue\b"),
    ("Acknowledgements", r"\backnowledgments?\b"),
    ("Epigraph", r"\bepigraph\b"),
    ("Colophon", r"\bcolophon\b"),
    ("Cover", r"\bcover\b"),
    ("Title Page", r"\btitlepage\b"),
    ("Appendix", r"\bappendix\b"),
    ("Glossary", r"\bglossary\b"),
    ("Index", r"\bindex\b"),
    ("Bibliography", r"\bbibliography\b"),
    ("Afterword", r"\b(backmatter|afterword)\b"),
)
FILE_TITLES = (
    ("Dedication", r"\b(dedication|widmung)\b"),
    ("Copyright", r"\b(copyright|legal|imprint|impressum|colophon)\b"),
    (None, r"\b(foreword|preface|prologue)\b"),  # the name itself, capitalised
    ("Introduction", r"\bintroduction\b"),
    ("Acknowledgements", r"\b(acknowledg(e)?ments?)\b"),
    ("About the Author", r"\b(about.?(the.?)?author|author.?bio|biography)\b"),
    ("Table of Contents", r"\b(toc|contents|tableofcontents)\b"),
    ("Epigraph", r"\b(epigraph|motto)\b"),
    ("Praise", r"\b(praise|reviews?)\b"),
    ("Also by This Author", r"\b(also.?by|other.?books)\b"),
)

# fixed values: invisible characters, wide spaces, quotes
INVISIBLE = "[\u200b-\u200f\u2060-\u2064\ufeff]"
SOFT_HYPHEN = "\u00ad"
WIDE_SPACE = "[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NO_BREAK_SPACE = "\u00a0"
COMPARE_DROPS = r"""["'„‚“”‘’«»‹›()\[\]]"""

# fixed values: lines that echo a chapter title
ECHO_LINES = (
    r"^(kapitel|chapter|teil|part|prolog|prologue|epilog|epilogue)$",
    r"^(kapitel|chapter|teil|part)\s*[\divxlcdm]+\.?$",
    r"^\d{1,4}$",
    r"^[ivxlcdm]+$",
    r"^(kapitel|chapter|teil|part)\s*\d+\s*[,:\-–—]",
)
NUMBERED_PART = r"^(kapitel|chapter|teil|part)\s*(\d+)"

# fixed values: provider errors
QUOTA_ERRORS = ("http 456", "http 429", "quota", "too many requests", "character limit")
NETWORK_ERRORS = ("etimedout", "econnreset", "econnrefused", "enotfound", "fetch failed", "network")
SERVER_ERROR = r"DeepL HTTP 5\d\d"

# fixed values: where a sentence ends, for chunking
SENTENCE_END = r"""[.!?…]+["'”’)\]]*\s*"""
