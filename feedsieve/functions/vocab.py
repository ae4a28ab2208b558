"""Word lists, patterns and limits that decide results.

Fixed values: they must equal the published behaviour, so they are stated plainly.
Terms are lower case; one of letters, digits, blanks, hyphens and apostrophes matches
between other characters, any other matches as a substring.
"""

from __future__ import annotations


def terms(text: str) -> tuple[str, ...]:
    """Terms of a comma-separated text, each once, in the order given."""
    return tuple(dict.fromkeys(t.strip() for t in text.replace("\n", " ").split(",") if t.strip()))


# Relevance vocabularies.
TIER1 = terms("""
bitcoin, btc, ethereum, eth, ether, solana, sol, xrp, ripple, bnb, stablecoin, usdt, usdc, tether,
spot etf, etf flows, etf inflows, etf outflows, etf approval, etf approvals, etf rejection, etf rejections,
sec, cftc, blackrock, coinbase, microstrategy, strategy inc, binance, grayscale, crypto regulation,
stablecoin bill, stablecoin law, genius act, mica,
federal reserve, the fed, fomc, ecb, boj, bank of japan, pboc, people's bank of china, bank of england, boe,
powell, lagarde, ueda,
cpi, core cpi, ppi, pce, nfp, nonfarm, non-farm, payrolls, jobs report, unemployment, inflation,
interest rate, interest rates, rate hike, rate cut, rate cuts, rate decision, rate hold, monetary policy,
treasury yield, treasury yields, 10-year, 2-year, dxy, dollar index,
s&p 500, s&p500, sp500, nasdaq, dow jones, apple, microsoft, nvidia, amazon, meta, alphabet, google, tesla,
magnificent seven, magnificent 7
""")
ECONOMIC_GEOPOLITICS = terms("""
tariff, tariffs, trade war, trade deal, sanctions, sanctioned, embargo, export controls, export ban, opec, opec+,
sovereign default, debt default, credit rating, downgrade us debt, us downgrade, government shutdown, debt ceiling,
election, elections, presidential election
""")
GEOPOLITICAL = ECONOMIC_GEOPOLITICS + terms("""
war, ceasefire, invasion, military strike, missile strike, taiwan, middle east, strait of hormuz, red sea,
russia ukraine, ukraine war, israel iran, iran israel, north korea
""")
TIER2 = terms("""
berkshire, jpmorgan, jp morgan, goldman sachs, morgan stanley, broadcom, amd, netflix, exxon, chevron, walmart,
eli lilly, visa, mastercard, palantir, oracle,
gold, xau, silver, oil, brent, wti, crude, natural gas, copper,
earnings, guidance, merger, acquisition, m&a, buyback, ipo, bankruptcy, layoffs, downgrade, upgrade, delisting,
altcoin, defi, mining, halving, hack, exploit, cardano, ada, avalanche, avax, polkadot, dot, chainlink, link,
litecoin, dogecoin, doge, toncoin, ton, aptos, sui, arbitrum, optimism, tron, trx, shiba, kraken, bybit, okx,
forex, fx, eur/usd, usd/jpy, gbp/usd, euro, yen, yuan, renminbi, pound, bond, bonds, yield, yields,
hedge fund, hedge funds, fund flows, fidelity, vanguard, institutional
""")
RELEVANT = terms(",".join(TIER1 + TIER2 + GEOPOLITICAL))
MARKET_ANCHOR = TIER1 + terms("oil, brent, wti, crude, natural gas, gold, xau, silver, copper") + ECONOMIC_GEOPOLITICS
CATALYST = terms("""
approves, approval, approved, rejects, rejected, rejection, announces, announced, unveils, launches, launched, files,
filing, sues, lawsuit, charged, settlement, fined, fine, hikes, cuts, raises, slashes, halts, suspends, freezes,
bans, ban, delays, postpones, beats, misses, record, all-time high, plunges, plunge, crashes, crash, soars, surges,
surge, tumbles, spikes, hack, hacked, breach, default, defaults, bankruptcy, acquires, acquired, stake, liquidation,
resigns, sanctions
""")
EVENT = terms("""
announces, announced, announce, unveils, unveiled, unveil, launches, launched, launch, introduces, introduced,
debuts, debuted, rolls out, rolled out, releases, released, lists, listed, listing, delists, delisted, relists,
acquires, acquired, acquisition, merges, merged, merger, buys, bought, purchases, purchased, sells, sold, stake,
partners, partnered, raises, raised, secures, secured, closes round, funding round, ipo, spinoff, spin-off,
delivers, delivered,
reports, reported, posts, posted, earnings, guidance, beats, beat, misses, missed, results,
approves, approved, approval, rejects, rejected, rejection, files, filed, filing, sues, sued, lawsuit, charges,
charged, settles, settled, settlement, fines, fined, rules, ruled, ruling, verdict, indicts, indicted, passes,
passed, enacts, enacted, signs, signed, ratifies, ratified, vetoes, vetoed, bans, banned, halts, halted, suspends,
suspended, freezes, froze, frozen, seizes, seized, imposes, imposed, investigates, investigated, probe, issues,
issued, orders, ordered, mandates, warns,
hikes, hiked, cuts, cut, raises rates, holds, held, decision, statement, minutes, release, released,
hack, hacked, hacks, breach, breached, exploit, exploited, drained, outage, halt, default, defaults, defaulted,
bankruptcy, liquidation, liquidated, recall, recalls, layoffs, lays off, resigns, resigned, steps down, appoints,
appointed, names, named, fires, fired, ousts,
upgrade, upgraded, goes live, went live, mainnet, activates, activated, record, all-time high, milestone, confirms,
confirmed, wins, won, hits, hit, reaches, reached, reach, tops, topped, touches, touched, crosses, crossed, breaches,
breached, surpasses, surpassed, returns, returned, recovers, recovered, rebounds, rebounded, extends, hovers,
ceasefire, invades, invaded, strikes, struck, agrees, agreed, withdraws, withdrew, deploys, deployed
""")
MOVE = terms("""
surges, surge, surged, soars, soar, soared, plunges, plunge, plunged, tumbles, tumble, tumbled, crashes, crash,
crashed, spikes, spike, spiked, rallies, rally, rallied, jumps, jump, jumped, drops, drop, dropped, falls, fall, fell,
rises, rise, rose, slides, slide, slid, slips, slip, slipped, climbs, climb, climbed, gains, gain, gained, sheds,
shed, sinks, sink, sank, tanks, tank, tanked, rockets, rocket, rocketed, dips, dip, dipped, spirals, craters, slumps,
slump, dives, dive, pops
""")
MEMECOIN = terms("""
dogecoin, doge, shiba, shib, shiba inu, pepe, bonk, floki, dogwifhat, wif, meme coin, memecoin, mog, brett, popcat,
bome, book of meme, siren, buildon, baby doge, turbo, mother, daddy, fartcoin, neiro
""")
REGIONAL = terms("""
ftse, ftse 100, dax, cac 40, cac, ibex, ftse mib, aex, smi, omx, wig20, athex, nikkei, topix, hang seng,
shanghai composite, csi 300, shenzhen, kospi, kosdaq, sensex, nifty, nifty 50, asx 200, asx, nzx, set index,
straits times, jakarta, psei, vn-index, klci, bursa, tadawul, bovespa, ibovespa, merval, moex, borsa istanbul,
bist 100, tsx, egx
""")
COMMENTARY = terms("""
analyst, analysts, strategist, strategists, outlook, opinion, commentary, op-ed, column, explainer, what to watch,
here's why, here is why, things to know, what to know, could, may, might, expected to, poised to, set to, forecast,
prediction, predicts, sees, view
""")
INFLUENTIAL = terms("""
powell, yellen, gensler, lagarde, musk, saylor, dalio, buffett, ackman, wood, cathie wood, fink, larry fink, dimon,
jamie dimon, draghi, trump, cz, changpeng zhao, armstrong, brian armstrong, blackrock, fidelity, grayscale,
federal reserve, ecb, imf, sec chair, treasury secretary
""")
SPEECH_FIGURES = terms("""
trump, bessent, lutnick, kashkari, waller, williams, daly, bostic, goolsbee, barr, cook, jefferson, ueda, centeno,
villeroy, nagel, de guindos, schnabel, treasury secretary, commerce secretary, fed chair, ecb president, sec chair,
sec chairman, трамп, пауэлл, лагард, йеллен, бессент, лютник, гензлер, уэда
""") + INFLUENTIAL
COMMENTARY_PHRASES = terms("""
according to, experts say, experts said, experts believe, experts think, analysts say, analysts said,
analysts believe, analysts think, some say, some believe, some think, many say, many believe, many think,
traders say, investors say, sources say, we believe, we think, we expect, we see, they believe, they think,
in my opinion, in our opinion, my view, our view, believe that, thinks that, opinion, op-ed, analysis, commentary,
perspective, editorial, blog, thread, podcast, newsletter, deep dive, looking back, look back, year in review,
year-in-review, year-end review, decade in review, in retrospect, retrospective, remember when, remember the,
what happened to, where are they now, the rise and fall, the story of, the history of, this day in history,
on this day, explainer, explained, demystified, decoded, guide to, beginner's guide, beginner guide, primer on,
understanding the, everything you need to know, all you need to know, what to know about, things to know about,
things to watch, need to know, things to know, the case for
""")
URL_SECTIONS = terms("""
/learn/, /education/, /academy/, /guide/, /guides/, /explainer/, /explained/, /analysis/, /price-analysis/,
/opinion/, /opinions/, /editorial/, /commentary/, /research/, /deep-dive/, /podcast/, /newsletter/
""")
OUTLETS = terms("""
coindesk, cointelegraph, reuters, bloomberg, financial times, ft.com, cnbc, wsj, wall street journal, the block,
theblock, decrypt, forbes, marketwatch, barron, axios, associated press, ap news, apnews, cnn, nasdaq.com,
the information, sec, u.s. securities, securities and exchange, federal reserve, the fed, ecb,
european central bank, imf, treasury, commodity futures, cftc
""")
# A comma ends a term, so the phrase with one stands alone.
RUMOR_PHRASES = terms("""
по данным источников, по слухам, по информации источников, не подтверж, reportedly, sources say,
according to sources, unconfirmed, rumor, rumour, allegedly, expected to, is considering, could, is in talks,
is weighing, is mulling, is exploring
""")
OFFICIAL_PHRASES = terms("""
press release, official statement, announced, has announced, confirmed, approved, signed into law, regulatory filing,
filed with, sec filing, files for, ruling, passed, enacted, officially, launched, launches, issued, ratified,
пресс-релиз, официально, подтверд, одобрил, подписал закон
""")
PLACEHOLDERS = (*terms("""
lorem ipsum, as an ai, as a language model, as an language model, i cannot, i'm sorry, i am sorry, не могу,
placeholder, вставьте, вставь сюда, ваш текст, your text here, <вставьте, [вставьте
"""), "извините, но")
REGULATION = terms("""
sec, регулятор, регулирован, закон, законопроект, law, ruling, court, lawsuit, settlement, fined, fine, sanction,
sanctions, санкции, clarity act, mica, cftc, регулир, судом, судебный
""")
DATA = terms("""
earnings, выручка, results, guidance, quarterly, квартал, прибыль, отчёт, отчет, cpi, ppi, pce, inflation, инфляц,
nfp, nonfarm, payrolls, jobs report, gdp, ввп
""")
STRONG_MOVE = terms("""
surge, surges, surged, soar, soared, plunge, plunges, plunged, crash, crashed, record, all-time, обвал, взлёт,
взлет, крах, рекорд
""")
FORBIDDEN = ("Суть:", "Оценка:", "Метка:", "Время:", "не указана", "вероятным последствием является", "ПРЕФИКС:", "ТЕКСТ:", "ТИКЕРЫ:", "ЗАГОЛОВОК:", "ВЛИЯНИЕ:", "АКТИВЫ:")

# Tags.
FLAG_TAGS = {"🇺🇸": "#сша", "🇪🇺": "#ес", "🇨🇳": "#китай", "🇷🇺": "#россия"}
THEME_TAGS = {
    "#регулирование": terms("sec, регулятор, регулирован, regulator, закон, law, ruling, court, lawsuit, settlement, fined, fine, sanction, sanctions, clarity act, mica"),
    "#ETF": ("etf",),
    "#отчётность": terms("earnings, выручка, results, guidance, quarterly, квартал, прибыль, отчёт, отчет"),
    "#макро": terms("cpi, ppi, pce, inflation, инфляц, rate, rates, ставк, fed, fomc, ecb, boj, pboc, powell, lagarde, nfp, nonfarm, payrolls, gdp, ввп, interest rate, monetary policy"),
    "#IPO": terms("ipo, листинг, listing"),
    "#безопасность": terms("hack, hacked, exploit, exploited, breach, взлом, drain, drained"),
}
GEO_TAGS = {
    "#сша": terms("united states, u.s., сша, america, американ, fed, federal reserve, sec, trump, biden, powell"),
    "#ес": terms("european union, europe, european, евросою, ecb, евроцентр, lagarde"),
    "#китай": terms("china, chinese, китай, pboc"),
    "#россия": terms("russia, russian, россия, россий"),
}

# Story keys.
ALIASES = {
    "bitcoin": "btc", "btc": "btc", "ethereum": "eth", "ether": "eth", "eth": "eth", "solana": "sol", "sol": "sol",
    "ripple": "xrp", "xrp": "xrp", "dogecoin": "doge", "doge": "doge", "cardano": "ada", "ada": "ada",
    "binance": "bnb", "bnb": "bnb", "litecoin": "ltc", "ltc": "ltc", "polkadot": "dot", "dot": "dot",
    "chainlink": "link", "link": "link", "polygon": "matic", "matic": "matic", "toncoin": "ton", "ton": "ton",
    "tron": "trx", "trx": "trx", "avalanche": "avax", "avax": "avax", "stablecoin": "stablecoin", "usdt": "usdt",
    "tether": "usdt", "usdc": "usdc", "coinbase": "coin", "coin": "coin", "gold": "gold", "oil": "oil",
    "brent": "oil", "wti": "oil", "nasdaq": "nasdaq", "nvidia": "nvda", "nvda": "nvda", "tesla": "tsla",
    "apple": "aapl", "aapl": "aapl",
}
STOPWORDS = terms("""
the, and, for, with, from, this, that, after, amid, into, over, says, say, could, will, have, has, are, was, were,
what, why, how, new, now, its, his, her, their, more, than, but, not, you, your, all, out, как, что, это, для, при,
над, под, его, она, они
""")
#: A word and the name that it goes by.
SYNONYMS = {
    "announces": "announce", "announced": "announce", "announcement": "announce", "unveils": "announce", "unveiled": "announce", "unveil": "announce", "reveals": "announce", "revealed": "announce", "introduces": "announce", "introduced": "announce", "debuts": "announce", "debuted": "announce", "presents": "announce", "presented": "announce",
    "launches": "launch", "launched": "launch", "releases": "launch", "released": "launch", "rollout": "launch", "rolls": "launch",
    "acquires": "acquire", "acquired": "acquire", "acquisition": "acquire", "buys": "acquire", "bought": "acquire", "purchases": "acquire", "purchased": "acquire", "purchase": "acquire",
    "raises": "raise", "raised": "raise", "secures": "raise", "secured": "raise",
    "approves": "approve", "approved": "approve", "approval": "approve",
    "rejects": "reject", "rejected": "reject", "rejection": "reject",
    "sues": "sue", "sued": "sue", "lawsuit": "sue",
    "charges": "charge", "charged": "charge",
    "partners": "partner", "partnership": "partner", "partnered": "partner",
    "hikes": "hike", "hiked": "hike",
}
MULTIPLIERS = {"k": 10**3, "тыс": 10**3, "thousand": 10**3, "m": 10**6, "млн": 10**6, "million": 10**6, "b": 10**9, "bn": 10**9, "млрд": 10**9, "billion": 10**9, "t": 10**12, "трлн": 10**12, "trillion": 10**12}
NUMBER = r"\$?[0-9][0-9.,]*\s*(?:k|m|bn|b|t|млрд|млн|трлн|тыс|thousand|million|billion|trillion)?%?"

# Patterns, without regard to case.
AD = r"\bsponsored\b|\bpromot(?:ed|ion)\b|\badvertis|\bpartner content\b|\bpress release\b|\bgiveaway\b|\bairdrop\b|\bcasino\b|\bbest .* to buy\b|\bprice prediction\b"
HOROSCOPE = r"price prediction|could (?:hit|reach|soar|surge|explode)|\bto the moon\b|\b\d+x\b|next (?:big|100x|1000x)"
OPINION = r"\bpredict|\bsays\b|\bbelieves\b|\bopinion\b|\bwarns\b"
ROUTINE = (
    r"\bmarket\s+wrap\b|\bclosing\s+bell\b|\bmid-?day\b|\bpre-?market\b|\bstocks?\s+to\s+watch\b|\bweek\s+ahead\b|\bday\s+ahead\b|\bmarket\s+recap\b"
    r"|\bstocks?\s+(?:end|close[ds]?|finish)\s+(?:mixed|flat|higher|lower)\b|\bwall\s+street\s+(?:wrap|recap)\b"
    r"|\b(?:s&p\s*500|sp\s*500|s&p500|nasdaq|dow|dow\s+jones|ftse|dax|nikkei|hang\s+seng|stoxx|cac)\s+(?:end[s]?|ended|close[ds]?|closed|finish(?:e[ds])?)\s+(?:mixed|flat|higher|lower|up|down)\b"
)
BARE_MOVE = r"\b(?:up|down|higher|lower|rises?|rose|falls?|fell|gains?|gained|drops?|dropped|slips?|slipped|climbs?|climbed|adds?|sheds?|loses?|lost|edges?|ticks?)\b[^.]{0,20}?\b\d+(?:\.\d+)?\s*%"
SPEECH_INTENT = (
    r"\b(?:to\s+(?:speak|address|testify|deliver(?:\s+remarks)?)|will\s+(?:speak|address|testify|deliver)"
    r"|(?:is|are)\s+(?:scheduled|expected|set)\s+to\s+(?:speak|address|testify|deliver|hold)"
    r"|scheduled\s+(?:speech|remarks|address|testimony|press\s+conference|hearing|appearance)"
    r"|(?:senate|house|congressional|confirmation)\s+(?:hearing|testimony)"
    r"|upcoming\s+(?:speech|address|remarks|appearance|hearing|testimony)|press\s+conference\s+(?:today|tomorrow|on)"
    r"|выступит|выступление|пресс[-\s]конференци|слушани)\b"
)
SPEECH_PAST = r"\b(?:spoke|addressed|testified|delivered|told\s+reporters|said\s+(?:earlier|on|that)|выступил)\b"
SPEECH_FUTURE = r"\b(?:will|to\s+\w+|scheduled|expected|upcoming|today|tomorrow|завтра|сегодня)\b"
HISTORICAL = (
    r"\b20(1[0-9]|2[0-4])\s*год\s*ста\w*|\bв\s+20(1[0-9]|2[0-4])\s+году\b|\bin\s+20(1[0-9]|2[0-4])\b|\bback\s+in\s+20(1[0-9]|2[0-4])\b"
    r"|\b20(1[0-9]|2[0-4])\s+(?:was|saw|marked|became|brought)\b|\b(?:year|years)\s+ago\b"
    r"|\b(?:on\s+this\s+day|throwback|retrospective|year[\s-]?in[\s-]?review|anniversary)\b"
    r"|\bретроспектив\w*|\b(?:годовщин\w+|итоги\s+20(1[0-9]|2[0-4]))"
)
YEAR_REFERENCE = (
    r"\b(?:since|last\s+seen\s+(?:in|since)|not\s+seen\s+since|seen\s+since|compared\s+(?:to|with)|versus|vs\.?"
    r"|(?:high|low|highest|lowest|strongest|weakest|best|worst|most|peak)[^.]{0,20}?\bsince)\s+(?:\w+\s+){0,3}?20[0-9]{2}\b"
)
RETRO_TOPIC = (
    r"^\s*20(?:1[0-9]|2[0-5])\b"
    r"|\b20(?:1[0-9]|2[0-5])\s+(?:was|were|saw|marked|became|brought|will\s+be\s+remembered|changed|turned|defined|reshaped)\b"
    r"|\bwhy\s+20(?:1[0-9]|2[0-5])\b|\blessons?\s+(?:from|of)\b"
    r"|\bthe\s+20(?:1[0-9]|2[0-5])\s+(?:bull|bear|crash|collapse|cycle|rally|crisis|boom|mania|meltdown|run)\b"
    r"|\b20(?:1[0-9]|2[0-5])\s+(?:bull\s+market|bear\s+market|cycle|crash|collapse|retrospective|mania|boom|meltdown)\b"
    r"|\b(?:cycle|market|crash|collapse)\s+(?:lessons|retrospective)\b"
)
FORECAST_MOVE = (
    r"\b(?:could|would|will|may|might|set\s+to|poised\s+to|expected\s+to|on\s+track\s+to|on\s+pace\s+to|likely\s+to|projected\s+to)\s+"
    r"(?:\w+\s+){0,2}?(?:reach|hit|rise|rally|surge|soar|climb|jump|top|tops|test|retest|revisit|return|rebound|recover|fall|drop|crash|plunge|sink|tumble|slide|dip|double|triple|moon|explode|breakout|break|reclaim)\b"
)
FORECAST_ANALYST = (
    r"\b(?:analysts?|strategists?|traders?|experts?|economists?|researchers?|bulls?|bears?)\b[^.]{0,40}?\b"
    r"(?:expect|expects|predict|predicts|forecasts?|see|sees|eye|eyes|target|targets|project|projects|anticipate|anticipates|brace)\b"
)
PRICE_TARGET = (
    r"\bprice\s+target\b|\btarget\s+price\b"
    r"|\b(?:raises?|raised|cuts?|cut|lifts?|lifted|lowers?|lowered|trims?|trimmed|sets?|set|boosts?|boosted|hikes?|slashes?)\s+(?:\w+\s+){0,3}?(?:price\s+)?target\b"
    r"|\bpt\s+(?:raised|cut|lifted|to)\b"
)
FORECAST_TOPIC = r"\b(?:outlook|forecast|prediction|predictions|thesis|investment\s+case|bull\s+case|bear\s+case|price\s+prediction|year\s+ahead\s+outlook)\b"
FORECAST_FACT = r"\b(?:than|vs\.?|versus|above|below|beat|beats|beating|topped?|tops|miss(?:ed|es)?|hotter|cooler|stronger|weaker|softer|in\s+line\s+with|matched?|exceeded?)\s+(?:\w+\s+){0,3}?forecast"
TECHNICAL = (
    r"\b(?:rsi|macd|fibonacci|fib\s+retracement|retracement|golden\s+cross|death\s+cross|double\s+top|double\s+bottom|head\s+and\s+shoulders|bollinger|moving\s+average|trend\s*line|chart\s+pattern|breakout|breakdown|overbought|oversold"
    r"|ascending\s+triangle|descending\s+triangle|falling\s+wedge|rising\s+wedge|bull\s+flag|bear\s+flag|pennant|elliott\s+wave|candle(?:stick)?\s+pattern|cup\s+and\s+handle|(?:50|100|200)[- ]?day\s+(?:ma|moving\s+average)|ema\b|sma\b)\b"
)
LEVEL = (
    r"\b(?:support|resistance)\s+(?:level|zone|line|area|band)\b|\b(?:key|major|critical|strong)\s+(?:support|resistance)\b"
    r"|\b(?:support|resistance)\b[^.]{0,15}?\$?\d[\d.,]*\s*[kK%]?\b|\bprice\s+level(?:s)?\b|\bkey\s+level(?:s)?\b"
)
CURRENT = r"\b(?:today|now|breaking|just\s+(?:announced|in|hit|crossed|posted)|upcoming|tonight|tomorrow|this\s+(?:morning|afternoon|evening|week)|will|сегодня|сейчас|завтра)\b"
NEWS_NUMBER = r"[$€£₽₿]\s?\d|\d[\d.,]*\s?%|\b\d[\d.,]*\s?(?:k|m|bn|b|tr|trillion|billion|million|thousand|млн|млрд|трлн|тыс)\b|\b\d{3,}\b"
QUESTION = r"^\s*(?:what|why|how|when|where|who|is|are|can|could|would|should|will)\b"
RETRO_EXPLAIN = r"\b(?:caused|causing|explains?|explained|blamed?|here'?s\s+why|reason\s+why|what\s+happened|looking\s+back)\b"
CRYPTO_SUBJECT = r"\b(?:bitcoin|btc|ethereum|eth|crypto|altcoin|solana|sol|xrp)\b"
URLS = r"https?://\S+|www\.\S+|t\.me/\S+"
RUMOR_WORD = r"\b(?:may|might)\b"

# Limits.
MIN_IMPACT, MAX_AGE_HOURS, STORY_HOURS, SUBJECT_HOURS, SUBJECT_MAX = 45, 24, 6, 12, 2
CYCLE_SECONDS, CYCLE_MAX, QUEUE_MAX, DAILY_LIMIT = 30, 3, 200, 1000
GRACE_MINUTES, TICK_SECONDS, MAX_TAGS, BREAKING_HOURS, MAX_POST = 20, 60, 4, 2, 1500
OFFSETS = {"24h": 86400, "1h": 3600}
DEFAULT_OFFSETS = {"critical": ("24h", "1h"), "standard": ("1h",), "special": ("1h",)}
STATUSES = ("scheduled", "cancelled")
