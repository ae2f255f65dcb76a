"""Word lists, tables and label forms that findings depend on."""

# Characters that OCR puts for digits, and the digits.
OCR_FROM, OCR_TO = "OoQDIil|!SsBZzG", "000011111558226"
OCR_CLASS = "[0-9OoQDIil|!SsBZzG]"

# Groups of characters that OCR confuses.
CONFUSABLE = ("li1|!jt", "o0qdc", "s5$", "b8h", "g9q", "z2", "ec", "uv", "nh", "ao", "ft")

# Months.
MONTHS = "january february march april may june july august september october november december".split()

# What ends names, stands before providers' and patients' names, and behind providers' names.
NAME_SUFFIXES = frozenset("jr sr ii iii iv v esq".split())
PROVIDERS = frozenset("dr doctor dra nurse prof professor".split())
CUES = frozenset(
    "patient pt patients mr mrs ms miss mx name client claimant plaintiff applicant insured member subscriber dear hi hello employee decedent "
    "minor beneficiary resident inmate defendant petitioner respondent injured worker guardian".split()
)
CREDENTIALS = "MD DO NP RN PA PA-C LVN LPN DC PhD PsyD DDS DMD OD DPM LCSW MFT LMFT FACS FACP FAAP DPT OTR CRNA APRN FNP CNP MSW".split()

#: Names that are everyday words too, by theme: colours, the year, land and weather, trades, beasts, virtues, ranks, qualities, things.
#: An own choice, and a parameter wherever names are matched.
EVERYDAY = frozenset(
    """
    white black brown green gray grey blue scarlet silver gold rose violet olive amber
    april may june august summer winter day noon easter
    hill lake forest wood woods field fields rivers brook marsh heath moore stone rock cliff snow frost rain storm moon lane park
    baker banks butcher butler carpenter carter cook cooper farmer fisher gardener gardner hunter mason miller porter potter shepherd singer
    taylor turner walker weaver wright page parker
    bird bishop crane drake finch fox hawk lamb swan wolf fish pike robin
    faith grace hope joy charity patience prudence constance chance
    king prince duke earl pope knight baron dean judge major marshal noble
    long short little small young strong sharp wise rich good hardy early swift love moody
    church hall house bell ball glass street wall temple cross cherry hazel holly ivy heather ginger penny price rice reed ray
    """.split()
)
#: Common first names, by public counts of given names; a parameter too.
FIRST_NAMES = frozenset(
    "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah christopher karen "
    "charles lisa daniel nancy matthew betty anthony sandra mark margaret donald ashley steven kimberly andrew emily paul donna joshua michelle kenneth "
    "carol kevin amanda brian melissa george deborah timothy stephanie ronald rebecca jason sharon edward laura jeffrey cynthia ryan dorothy jacob amy "
    "gary kathleen nicholas angela eric shirley jonathan emma stephen brenda larry pamela justin nicole scott anna brandon samantha benjamin katherine "
    "samuel christine gregory helen alexander debra patrick rachel frank carolyn raymond janet jack maria dennis catherine jerry heather tyler diane "
    "aaron olivia jose julie adam joyce nathan victoria henry ruth zachary virginia douglas lauren peter kelly kyle christina noah joan jane ana".split()
)

# Street suffixes, directions, units and states with their short forms.
STREETS = dict(
    street="st", st="st", str="st", avenue="ave", ave="ave", av="ave", boulevard="blvd", blvd="blvd", road="rd", rd="rd", drive="dr", dr="dr", lane="ln", ln="ln",
    court="ct", ct="ct", circle="cir", cir="cir", place="pl", pl="pl", way="way", wy="way", terrace="ter", ter="ter", parkway="pkwy", pkwy="pkwy", highway="hwy",
    hwy="hwy", trail="trl", trl="trl", square="sq", sq="sq", loop="loop", alley="aly", aly="aly", plaza="plz", plz="plz", crescent="cres", cres="cres", row="row",
    run="run", path="path", pike="pike", expressway="expy", expy="expy", freeway="fwy", fwy="fwy", center="ctr", ctr="ctr", point="pt", pt="pt", heights="hts",
    hts="hts", commons="cmns", grove="grv", grv="grv",
)
DIRECTIONS = frozenset("north n south s east e west w northeast ne northwest nw southeast se southwest sw".split())
UNITS = frozenset("apt apartment unit ste suite space spc lot rm room bldg building fl floor no trlr".split())
STATES = dict(
    alabama="al", alaska="ak", arizona="az", arkansas="ar", california="ca", colorado="co", connecticut="ct", delaware="de", florida="fl", georgia="ga", hawaii="hi",
    idaho="id", illinois="il", indiana="in", iowa="ia", kansas="ks", kentucky="ky", louisiana="la", maine="me", maryland="md", massachusetts="ma", michigan="mi",
    minnesota="mn", mississippi="ms", missouri="mo", montana="mt", nebraska="ne", nevada="nv", ohio="oh", oklahoma="ok", oregon="or", pennsylvania="pa",
    tennessee="tn", texas="tx", utah="ut", vermont="vt", virginia="va", washington="wa", wisconsin="wi", wyoming="wy", calif="ca", cal="ca",
)

# Label forms, as patterns without blanks: those that are labels alone, and words that need a mark behind them.
MARKS = {"any": r"\.?\s*(?:#|num(?:ber)?|no\.?|id)", "number": r"\.?\s*(?:#|num(?:ber)?|no\.?)", "id": r"\.?\s*(?:#|no\.?|id)", "account": r"\.?\s*(?:account|acct)"}
LICENCE_BARE = r"driver'?s?[\s-]*lic(?:ense|\.)? operator'?s?\s*lic(?:ense)? cdl dln D\.?\s?L\.?(?=\s*(?:#|no(?![\p{L}\p{N}_])|num|:|\s+\S*[0-9]))"
LICENCE_MARKED = {"number": "license lic"}
RECORD_BARE = "ncic cii sid cdcr"
RECORD_MARKED = {"number": r"fbi booking state\s*id(?:entification)?", "any": "inmate"}
ACCOUNT_BARE = r"""
    account(?:\s*holder)? acct(?:\s*holder)? a/c bank routing aba mrn m\.r\.n\.? medical\s*records?\.? med\.?\s*rec(?:ord)?s?\.? chart policy(?:\s*holder)? claim clm
    member(?:ship)? mbr subscriber sub\.?\s*id grp insured\s*id insurance\s*id ins\.?\s*id id\s*card id\s*# medi[-\s]cal medicare medicaid mbi hicn cin certificate
    accession tin ein itin passport har fin csn epi
"""
ACCOUNT_MARKED = {
    "any": "patient group encounter", "number": r"card invoice statement auth(?:orization)? case file", "id": "pt visit beneficiary employee emp guarantor pol", "account": "patient pt",
}
SSN_LABELS = ("SSN", r"S\.\s?S\.\s?N\.?", r"SS\s?#", r"SS\s*No\.?", r"Soc(?:ial)?\.?\s*Sec(?:urity)?\.?(?:\s*(?:#|No\.?|Num(?:ber)?))?")
