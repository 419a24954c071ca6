"""Brands, look-alike domains and mail word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions.text import has_suffix, literal, registered_domain

# Brands and the domains they own, in match order.
BRANDS = {
    "paypal": ["paypal.com", "paypal.co.uk", "paypalobjects.com", "paypal-communication.com"],
    "microsoft": ["microsoft.com", "microsoftonline.com", "office.com", "office365.com", "live.com", "outlook.com",
                  "sharepoint.com", "onedrive.com", "microsoft365.com", "azure.com", "windows.com", "msn.com"],
    "google": ["google.com", "gmail.com", "googlemail.com", "youtube.com", "googleapis.com", "gstatic.com", "goo.gl"],
    "apple": ["apple.com", "icloud.com", "itunes.com", "me.com", "mac.com"],
    "amazon": ["amazon.com", "amazon.co.uk", "amazonaws.com", "aws.amazon.com", "amazon.de", "amazon.in", "primevideo.com"],
    "netflix": ["netflix.com", "nflxext.com", "nflximg.net", "netflix.net"],
    "dhl": ["dhl.com", "dhl.de", "dhlexpress.com", "dhlparcel.com"],
    "fedex": ["fedex.com", "fedex.co.uk"], "ups": ["ups.com", "upsmail.com"], "usps": ["usps.com", "usps.gov"],
    "adobe": ["adobe.com", "adobelogin.com", "acrobat.com", "adobesign.com"],
    "docusign": ["docusign.com", "docusign.net"], "dropbox": ["dropbox.com", "dropboxmail.com"],
    "linkedin": ["linkedin.com", "licdn.com"], "facebook": ["facebook.com", "fb.com", "meta.com", "fbcdn.net"],
    "instagram": ["instagram.com", "cdninstagram.com"], "whatsapp": ["whatsapp.com", "whatsapp.net"],
    "chase": ["chase.com", "jpmorganchase.com"], "wellsfargo": ["wellsfargo.com"],
    "bankofamerica": ["bankofamerica.com", "bofa.com"], "hsbc": ["hsbc.com", "hsbc.co.uk"],
    "barclays": ["barclays.co.uk", "barclays.com"], "citibank": ["citi.com", "citibank.com"],
    "americanexpress": ["americanexpress.com", "aexp.com"], "ebay": ["ebay.com", "ebay.co.uk", "ebaystatic.com"],
    "stripe": ["stripe.com"], "coinbase": ["coinbase.com"], "binance": ["binance.com"], "zoom": ["zoom.us", "zoom.com"],
    "slack": ["slack.com", "slack-edge.com"], "github": ["github.com", "githubusercontent.com"],
    "hmrc": ["hmrc.gov.uk", "gov.uk"], "irs": ["irs.gov"], "walmart": ["walmart.com"], "target": ["target.com"],
    "att": ["att.com"], "verizon": ["verizon.com"], "spotify": ["spotify.com"],
}
# Words that claim a brand.
BRAND_WORDS = {
    "paypal": ["paypal", "pay pal"],
    "microsoft": ["microsoft", "office 365", "office365", "onedrive", "sharepoint", "outlook", "ms teams", "microsoft teams", "windows"],
    "google": ["google", "gmail", "g suite", "google drive"], "apple": ["apple", "icloud", "itunes", "apple id", "app store"],
    "amazon": ["amazon", "aws", "prime video"],
    "netflix": ["netflix", "netflx", "netlfix", "netfilx", "netllx", "netflix billing"],
    "dhl": ["dhl", "dhl express"], "fedex": ["fedex", "federal express"], "ups": ["ups", "united parcel"],
    "usps": ["usps", "postal service"], "adobe": ["adobe", "acrobat", "adobe sign", "adobe pdf"],
    "docusign": ["docusign", "docu sign"], "dropbox": ["dropbox"], "linkedin": ["linkedin"], "facebook": ["facebook", "meta"],
    "chase": ["chase bank", "jpmorgan"], "wellsfargo": ["wells fargo"], "bankofamerica": ["bank of america", "bofa"],
    "hsbc": ["hsbc"], "barclays": ["barclays"], "citibank": ["citibank", "citi bank"],
    "americanexpress": ["american express", "amex"], "ebay": ["ebay"], "stripe": ["stripe"], "coinbase": ["coinbase"],
    "binance": ["binance"], "zoom": ["zoom meeting", "zoom video"], "slack": ["slack"], "github": ["github"],
    "hmrc": ["hmrc", "hm revenue"], "irs": ["irs", "internal revenue"], "spotify": ["spotify"],
}
AUTHORITY = ["distribution center", "distribution centre", "shipping department", "billing department", "accounts payable",
             "it helpdesk", "it support", "help desk", "security team", "hr department", "human resources", "payroll",
             "system administrator", "postmaster", "mail delivery", "customer service", "customer support",
             "account services", "support team"]
# Sender domain classes.
FREEMAIL = ["gmail.com", "yahoo.com", "yahoo.co.uk", "hotmail.com", "outlook.com", "live.com", "aol.com", "mail.com", "gmx.com",
            "gmx.net", "yandex.com", "yandex.ru", "zoho.com", "protonmail.com", "proton.me", "icloud.com", "inbox.com",
            "fastmail.com", "tutanota.com", "163.com", "qq.com", "126.com"]
DISPOSABLE = ["mailinator.com", "guerrillamail.com", "10minutemail.com", "tempmail.com", "throwawaymail.com", "yopmail.com",
              "sharklasers.com", "getnada.com", "temp-mail.org", "trashmail.com", "maildrop.cc", "dispostable.com"]
ABUSED_TLDS = ["zip", "mov", "top", "xyz", "club", "click", "link", "work", "gq", "cf", "ml", "ga", "tk", "buzz", "rest",
               "monster", "cyou", "quest", "surf", "icu", "sbs", "cfd", "bond", "lol", "loan", "download", "review", "country",
               "stream", "date", "racing", "science", "party", "faith", "accountant"]
# Characters that look alike, ambiguous brand labels, decoy words.
CASE_ALIKE = {"I": "l", "O": "0", "S": "5", "B": "8", "Z": "2", "G": "6"}
ALIKE = {
    "0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a", "!": "i", "|": "l",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ѡ": "w", "ν": "v", "ο": "o",
    "α": "a", "ρ": "p", "τ": "t", "ι": "i", "κ": "k", "ϲ": "c",
}
PAIRS_ALIKE = [("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("nn", "m")]
AMBIGUOUS = ["live", "target", "chase", "stripe", "meta", "apple", "shell", "orange", "square", "discover", "mint", "monitor"]
DECOYS = ["secure", "login", "signin", "account", "accounts", "verify", "verification", "support", "service", "services",
          "billing", "update", "confirm", "auth", "portal", "mail", "online", "my", "web", "help", "id", "customer", "alert",
          "notice", "team"]


def skeleton(c: Column) -> Column:
    """Visual skeleton: characters and pairs that look alike become equal."""
    for table, fold in ((CASE_ALIKE, F.lower), (ALIKE, lambda x: x)):
        c = fold(F.translate(c, "".join(table), "".join(table.values())))
    for a, b in PAIRS_ALIKE:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, "[-_.]", "")


def brand_of(domain: Column) -> Column:
    """The brand that owns a domain, if any."""
    out = F.lit(None).cast("string")
    for brand, domains in reversed(BRANDS.items()):
        out = F.when(has_suffix(domain, domains), brand).otherwise(out)
    return out


def owned_by_brand(domain: Column) -> Column:
    return has_suffix(domain, [d for ds in BRANDS.values() for d in ds])


def _word(words) -> str:
    return "(?<![a-z0-9])(?:" + "|".join(literal(w) for w in words) + ")(?![a-z0-9])"


def claims_a_brand(text: Column) -> Column:
    """Some brand word stands in the text as a word."""
    return F.coalesce(F.lower(text).rlike(_word([w for ws in BRAND_WORDS.values() for w in ws])), F.lit(False))


def brands_mentioned(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(_word(ws)), b) for b, ws in BRAND_WORDS.items()]))


def lookalikes(domains: DataFrame, column: str = "domain") -> DataFrame:
    """Domains that imitate a brand: domain, brand, legit, technique. Input is reduced to distinct
    domains; each is tested against the fixed list of brand domains, first match in list order."""
    d = domains.select(F.col(column).alias("domain")).where(F.col("domain") != "").distinct()
    d = d.where(~owned_by_brand(F.regexp_replace(F.lower("domain"), r"^\.+|\.+$", "")))
    bare = F.regexp_replace("domain", r"^\.+|\.+$", "")
    d = d.select("domain", bare.alias("bare"), registered_domain(F.col("domain")).alias("reg"))
    keep = F.substr("bare", F.length("bare") - F.length("reg") + 1)
    label = F.split_part(keep, F.lit("."), F.lit(1))
    tokens = F.filter(F.split(label, "[-_]"), lambda t: t != "")
    subs = F.filter(F.split(F.regexp_replace(F.substr("bare", F.lit(1), F.length("bare") - F.length("reg")), r"^\.+|\.+$", ""), r"\."), lambda t: t != "")
    d = d.select("domain", F.lower(label).alias("label"), skeleton(label).alias("skel"),
                 F.transform(tokens, lambda t: F.struct(F.lower(t).alias("t"), skeleton(t).alias("s"))).alias("tok"),
                 F.transform(subs, lambda t: F.struct(F.lower(t).alias("t"), skeleton(t).alias("s"))).alias("sub"))
    legit = [(i, b, x) for i, (b, x) in enumerate((b, x) for b, ds in BRANDS.items() for x in ds)]
    dim = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(b).alias("brand"), F.lit(x).alias("legit")) for i, b, x in legit])
    rows = d.withColumn("b", F.explode(dim)).select("*", "b.*").drop("b")
    rows = rows.withColumn("l", F.split_part("legit", F.lit("."), F.lit(1)))
    rows = rows.withColumn("ls", skeleton(F.col("l")))
    n, differs = F.length("l"), F.col("label") != F.col("l")
    decoy = "|".join(DECOYS)

    def token_hit(x):
        others = F.concat_ws(" ", F.transform(F.filter("tok", lambda y: y["t"] != x["t"]), lambda y: y["t"]))
        clear = ~F.col("l").isin(AMBIGUOUS) | others.rlike(decoy)
        return ((x["t"] == F.col("l")) | (x["s"] == F.col("ls"))) & clear

    def affix_hit(x):
        rest = F.concat(F.split_part(x["t"], F.col("l"), F.lit(1)), F.substr(x["t"], F.instr(x["t"], F.col("l")) + n))
        edge = x["t"].startswith(F.col("l")) | x["t"].endswith(F.col("l"))
        return (x["t"] != F.col("l")) & x["t"].contains(F.col("l")) & edge & (rest.rlike(decoy) | rest.rlike("^[0-9]+$"))
    dist = F.levenshtein("label", "l", 2)
    technique = (F.when(n < 4, F.when(differs & F.exists("tok", lambda x: x["t"] == F.col("l")), "brand-in-label"))
                 .when(differs & (F.col("skel") == F.col("ls")), "exact-skeleton")
                 .when(differs & F.exists("tok", token_hit), "brand-in-label")
                 .when(dist.between(1, F.when(n <= 6, 1).otherwise(2)), "typo")
                 .when(F.exists("tok", affix_hit), "brand-in-label")
                 .when(F.exists("sub", lambda x: (x["t"] == F.col("l")) | (x["s"] == F.col("ls"))), "brand-subdomain"))
    hit = rows.withColumn("technique", technique).where(F.col("technique").isNotNull())
    return hit.groupBy("domain").agg(F.min_by(F.struct("brand", "legit", "technique"), "ord").alias("m")).select("domain", "m.*")
