"""Per-message normalisation as column functions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mail providers, applicant systems and schedulers, whose domain never names an employer.
PROVIDERS = (
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "yahoo.com", "icloud.com", "me.com", "proton.me",
    "protonmail.com", "fastmail.com", "aol.com", "linkedin.com", "greenhouse.io", "lever.co", "ashbyhq.com", "myworkday.com",
    "goodtime.io", "interviews.modernloop.io",
)

# Agencies of the mailbox that the rules were made on; a caller with another one gives its own.
AGENCIES = (
    "jkpartner.com", "mavenpartnership.com", "alldus.com", "cpi-search.com", "acaciarecruits.com", "selbyjennings.com", "topfunneltalent.com", "brisktalent.com", "intelletec.com", "emaago.com",
)

# Domains of mail, calendars, meetings and signatures, which rules made from summaries never touch.
NEVER_RULED = (
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "yahoo.com", "icloud.com", "me.com", "aol.com", "proton.me",
    "protonmail.com", "linkedin.com", "calendly.com", "cal.com", "zoom.us", "google.com", "docusign.net", "docusign.com",
)

# Legal suffixes of company names (after splitting on anything but letters and digits), and seniority words.
SUFFIXES = ("inc", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "gmbh", "bv", "ag", "sa", "plc", "pty", "holdings", "group", "technologies", "technology", "labs", "software")
TITLE_STOPWORDS = ("senior", "sr", "staff", "principal", "lead", "junior", "jr", "i", "ii", "iii", "iv", "the", "a", "an", "of", "and", "for", "at")
NO_REPLY = ("no-reply", "noreply", "donotreply", "do-not-reply", "notifications")

# Words of descriptions that are no company's name, single words that are none, and what stands for nothing.
DESCRIPTOR_WORDS = ("startup", "startups", "company", "firm", "fund", "unicorn", "stealth", "backed", "leading", "growing", "series", "pre-ipo", "scale-up", "scaleup", "platform", "vendors", "business", "unknown", "tier")
STOPWORD_NAMES = ("this", "that", "career", "careers", "upcoming", "go", "hi", "hello", "on-site", "onsite", "unknown", "team", "jobs", "job", "linkedin")
NOTHING = ("none", "null", "n/a", "unknown")

# Phrases that say how a process ended.
TERMINAL_TERMS = ("offer letter", "job offer", "we are pleased to offer", "welcome to ", "rejection", "we regret", "unfortunately", "background check", "onboarding", "i-9", "w-4", "h-1b", "benefits enrollment", "start date", "congratulations")

# Fixed patterns: subjects that evidence an offer, a signature, paperwork, a calendar answer, a hire.
OFFER_EVIDENCE = r"(?i)\b(offer|congrat|welcome|onboard|hire[dn]?\b|start\s+date|compensation|salary|equity|counter[- ]?sign|employment)\b"
ESIGN_SENDER = r"(?i)(docusign|hellosign|adobesign|pandadoc|signnow)"
ESIGN_EVIDENCE = r"(?i)\b(offer|employment|congrat|welcome|hire|onboard|start\s+date|compensation|salary|equity)\b"
PAPERWORK = r"(?i)\b(offer\s+letter|offer\s+package|compensation|salary|counter[- ]?sign|start\s+date|equity|base\s+pay)\b"
CALENDAR_ANSWER = r"(?i)(accepted|declined|tentative):\s"
WELCOME = r"(?i)\bwelcome\s+to\b"
ONBOARDING = r"(?i)\b(welcome\s+(?:to|aboard)|onboarding|new\s+hire|first\s+day|start\s+date|i-?9\b|w-?4\b|payroll|benefits\s+enrol|offer\s+letter|equity\s+grant|badge|laptop\s+setup)\b"
AMBIGUOUS = r"(?i)\b(h-?1b|lca\s+posting|labor\s+condition|visa\s+(?:transfer|petition)|immigration|support\s+letter|background\s+check)\b"
CORROBORATION = r"(?i)\b(filed|approved|receipt\s+notice|uscis|petition|congratulations|congrats|signed|countersigned|accepted|next\s+steps|employee)\b"
OUTCOME_SUBJECT = r"(?i)\b(offer|welcome\s+to|congratulat|onboard|new\s+hire|start\s+date|background\s+check|i-9|w-4|payroll|equity|compensation|unfortunat|not\s+moving\s+forward|regret|declin|withdraw|h-?1b|lca|visa|immigration)\b"
NOT_ONBOARDING = r"(?i)\b(newsletter|subscri|community|webinar|waitlist)\b"

# Words without content, for shared words of a query and a message.
STOPWORDS = tuple(
    "a an the and or but of to in on at for with from about into over after before is are was were be been being am i me my mine we us our you your "
    "they them their he she it its this that these those there here anyone someone anybody somebody anything something who whom what when where why how "
    "any some all both each few more most other such no nor not only own same so than too very can will just should now would could may might must have "
    "has had do does did done get got".split()
)


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != "")


def _list(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def domain_of(address: Column) -> Column:
    """What follows the first @, in lower case; empty without one."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_extract(address, r"(?s)^[^@]*@(.*)$", 1)), r"^>+|>+$", ""))


def automated(address: Column) -> Column:
    """no-reply, linkedin-relay, or null for a person."""
    local = F.lower(F.regexp_replace(F.trim(F.split(address, "@", 2)[0]), r"^<+|<+$", ""))
    silent = local.isin(*NO_REPLY) | local.startswith("no-reply") | local.startswith("noreply")
    return F.when(silent, "no-reply").when(F.contains(F.lower(address), F.lit("hit-reply@linkedin.com")), "linkedin-relay")


def normalise_company(name: Column) -> Column:
    """Words in lower case without the legal suffixes at the end."""
    joined = F.array_join(_words(name), " ")
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), joined), "( (" + "|".join(SUFFIXES) + "))+$", ""))


def normalise_domain(domain: Column) -> Column:
    """Without scheme, path, leading www. and trailing dots."""
    bare = F.split(F.regexp_replace(F.lower(F.trim(domain)), "^https?://", ""), "/")[0]
    return F.regexp_replace(F.regexp_replace(bare, r"^www\.", ""), r"\.+$", "")


def suffixes(domain: Column) -> Column:
    """The domain and its parents, without the last label alone, the longest first; an equi-join on them replaces suffix matching."""
    tails = lambda labels: F.when(F.size(labels) > 1, F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))
    # as the argument of a lambda the labels are split once, and not again for each suffix
    return F.element_at(F.transform(F.array(F.split(domain, r"\.")), tails), 1)


def generic(domain: Column, agencies: tuple[str, ...] = AGENCIES) -> Column:
    """A shared provider's domain or one under it, or one of the agencies that write for many employers: those differ from mailbox to mailbox."""
    return F.coalesce(F.arrays_overlap(suffixes(domain), _list((*PROVIDERS, *agencies))), F.lit(False))


def alias_forms(name: Column, domain: Column) -> Column:
    """Spaced and squashed normal forms of the name and of the domain's first label, in order, without repeats."""
    label = normalise_company(F.split(domain, r"\.")[0])
    plain = normalise_company(name)
    forms = F.array(plain, F.replace(plain, F.lit(" "), F.lit("")), label, F.replace(label, F.lit(" "), F.lit("")))
    return F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (x != "")))


def title_tokens(title: Column) -> Column:
    return F.array_except(_words(title), _list(TITLE_STOPWORDS))


def same_role(left: Column, right: Column) -> Column:
    """Whether two titles share 0.6 of their words; a missing title matches nothing."""
    a, b = title_tokens(left), title_tokens(right)
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)) >= 0.6), F.lit(False))


def clean(value: Column, lower: bool = False) -> Column:
    """Trimmed text, or null for what only says that there is none."""
    text = F.trim(value)
    kept = F.when((text != "") & ~F.lower(text).isin(*NOTHING), text)
    return F.lower(kept) if lower else kept


def names_a_company(name: Column, domain: Column) -> Column:
    """A domain, or a name that is no description of an employer."""
    words = F.filter(F.transform(F.split(F.trim(name), r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[.,!?()\-—:]+|[.,!?()\-—:]+$", ""))), lambda w: w != "")
    odd = F.regexp_like(F.trim(name), F.lit(r"[\r\n]")) | (F.size(words) > 5) | ((F.size(words) == 1) & words[0].isin(*STOPWORD_NAMES)) | F.arrays_overlap(words, _list(DESCRIPTOR_WORDS))
    return F.coalesce(domain != "", F.lit(False)) | F.coalesce((F.trim(name) != "") & ~odd, F.lit(False))


def looks_terminal(subject: Column, text: Column) -> Column:
    hay = F.lower(F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))
    return F.exists(_list(TERMINAL_TERMS), lambda t: F.contains(hay, t))


def content_words(text: Column) -> Column:
    """Distinct words of three letters or more that carry content."""
    return F.array_except(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z][a-z']{2,})"), F.lit(1)), _list(STOPWORDS))


def shared_words(query: Column, text: Column) -> Column:
    return F.sort_array(F.array_intersect(content_words(query), content_words(text)))


def strip_html(html: Column) -> Column:
    """Without script and style blocks and tags; common named and numeric entities resolved."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(plain))
    return bare


def collapse(text: Column) -> Column:
    """One kind of line end, one space for runs of blanks, no zero bytes, trimmed."""
    lines = F.replace(F.replace(F.regexp_replace(text, r"\r\n?", "\n"), F.lit(" "), F.lit(" ")), F.lit("\u0000"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(lines, r"[ \t]+", " "), r"^\s+|\s+$", "")


# Fixed patterns: where a quoted reply or a footer begins.
_QUOTES = (r"(?ms)^On .{0,300}?wrote:[ \t]*$", r"(?m)^From:.*\n[ \t]*Sent:.*\n[ \t]*To:.*\n[ \t]*Subject:.*$", r"-{3,}\s*\n+\s*This email was intended for", r"This email was intended for")


def strip_quoted(text: Column) -> Column:
    """Cut at the first marker of a quoted reply or footer."""
    places = [F.when(F.regexp_instr(text, F.lit(p)) > 0, F.regexp_instr(text, F.lit(p))) for p in _QUOTES]
    return F.regexp_replace(F.substring(text, F.lit(1), F.coalesce(F.least(*places) - 1, F.length(text))), r"\s+$", "")


def body_text(plain: Column, html: Column, limit: int | None = None) -> Column:
    """What an author wrote: the plain part, else the HTML part without markup; whole, unless a caller sets a limit."""
    text = strip_quoted(collapse(F.coalesce(plain, strip_html(html), F.lit(""))))
    return text if limit is None else F.substring(text, 1, limit)


def direction(senders: Column, account: Column) -> Column:
    """outbound if the account is among the senders."""
    return F.when(F.coalesce(F.array_contains(F.transform(senders, lambda a: F.lower(a)), F.lower(account)), F.lit(False)), "outbound").otherwise("inbound")


def reply_subject(subject: Column) -> Column:
    text = F.trim(F.coalesce(subject, F.lit("")))
    return F.when(F.lower(text).startswith("re:"), text).otherwise(F.rtrim(F.concat(F.lit("Re: "), text)))


def references_chain(references: Column, in_reply_to: Column, message_id: Column) -> Column:
    """The parent's chain, or what it replies to, and its own identifier; null without any."""
    ids = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")
    chain = F.when(F.size(ids(references)) > 0, ids(references)).otherwise(ids(in_reply_to))
    whole = F.concat(chain, F.array_compact(F.array(message_id)))
    return F.when(F.size(whole) > 0, F.array_join(whole, " "))


def _once(value: Column, of) -> Column:
    """of(value), with the value worked out once: as the argument of a lambda, and not wherever it is named."""
    return F.element_at(F.transform(F.array(value), of), 1)


def unique_addresses(addresses: Column, drop: Column) -> Column:
    """In order, letter case aside, without those of ``drop``."""
    rest = lambda s, low: F.filter(s["all"], lambda _, i: (F.array_position(low, F.get(low, i)) == i + 1) & ~F.array_contains(s["drop"], F.get(low, i)))
    return _once(F.struct(addresses.alias("all"), drop.alias("drop")), lambda s: _once(F.transform(s["all"], lambda a: F.lower(a)), lambda low: rest(s, low)))


def reply_recipients(reply_to: Column, sender: Column, to: Column, cc: Column, own: list[str]) -> Column:
    """Struct of to and cc of an answer to all; an answer to the sender alone takes only to.

    What the mail asks to reply to comes before its sender; mail of one's own is followed up to those it went to.
    All are lists of addresses; a null one is empty.
    """
    none = F.array().cast("array<string>")
    mine = F.array(*[F.lit(a.lower()) for a in own]) if own else none
    some = lambda c: F.coalesce(c, none)
    back = unique_addresses(F.when(F.size(some(reply_to)) > 0, reply_to).otherwise(some(sender)), none)
    chosen = lambda b: F.when(F.forall(b, lambda a: F.array_contains(mine, F.lower(a))), unique_addresses(some(to), mine)).otherwise(b)
    rest = lambda t: unique_addresses(F.concat(some(to), some(cc)), F.concat(mine, F.transform(t, lambda a: F.lower(a))))
    return _once(_once(back, chosen), lambda t: F.struct(t.alias("to"), rest(t).alias("cc")))


def welcome_names(subject: Column, company: Column) -> Column:
    """A welcome counts only if it names the employer; other subjects pass."""
    words = F.filter(F.transform(F.split(company, r"\s+"), lambda w: F.lower(w)), lambda w: (F.length(w) > 2) & ~w.isin("inc", "llc", "ltd", "the", "and"))
    return ~F.coalesce(F.regexp_like(subject, F.lit(WELCOME)), F.lit(False)) | F.coalesce(F.exists(words, lambda w: F.contains(F.lower(subject), w)), F.lit(False))


def is_evidence(stage: Column, subject: Column, sender: Column, way: Column) -> Column:
    """Whether a subject can support a claim of offer, acceptance or refusal; other stages pass."""
    text = F.coalesce(subject, F.lit(""))
    like = lambda p: F.regexp_like(text, F.lit(p))
    answer = stage.isin("accepted", "declined")
    signed = ~F.regexp_like(F.coalesce(sender, F.lit("")), F.lit(ESIGN_SENDER)) | like(ESIGN_EVIDENCE)
    offer = like(OFFER_EVIDENCE) & ((way != "outbound") | like(PAPERWORK))
    return F.when(stage == "offer", offer & signed).when(answer, ~like(CALENDAR_ANSWER) & signed).otherwise(F.lit(True))


def explored(match_type: Column, value: Column, message_id: Column, rate: float = 0.02) -> Column:
    """A fixed share of negatives that are read all the same: md5 of rule and message, modulo 10,000."""
    digest = F.md5(F.concat(match_type, F.lit(":"), F.lower(value), F.lit(":"), message_id.cast("string")).cast("binary"))
    rest = F.lit(0).cast("long")
    for k in range(4):
        rest = (rest * 4294967296 + F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")) % 10000
    return rest < int(rate * 10_000)


def content_hash(source: Column, account: Column, payload: Column, scheme: str) -> Column:
    """SHA-256 over parts that are each preceded by their length in eight bytes."""
    framed = [F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p).cast("long")), 16, "0")), p) for p in (F.lit(scheme).cast("binary"), source.cast("binary"), account.cast("binary"), payload)]
    return F.sha2(F.concat(*framed), 256)


def storage_key(source: Column, digest: Column, occurred_at: Column) -> Column:
    """raw/<source>/<year>/<month>/<day>/<time>_<hash>.jsonl, or an unknown date."""
    at = occurred_at if not isinstance(occurred_at, str) else F.col(occurred_at)
    dated = F.concat(F.date_format(at, "yyyy/MM/dd/HHmmss"))
    return F.concat(F.lit("raw/"), source, F.lit("/"), F.coalesce(dated, F.lit("unknown-date/unknown-date/unknown-date/000000")), F.lit("_"), digest, F.lit(".jsonl"))
