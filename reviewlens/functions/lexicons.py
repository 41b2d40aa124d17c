"""Word lists used by the text rules.

All of them are plain Python values; every function that uses one takes it as a
parameter with the list here as default.
"""

# Aspect names in evaluation order and the phrases that signal them.
ASPECTS = {
    "UI/UX": [
        "beautiful", "button", "clean", "cluttered", "confusing", "dark mode", "design", "interface",
        "intuitive", "layout", "look", "menu", "navigation", "screen", "simple", "theme", "ugly", "ui",
        "user friendly", "ux",
    ],
    "Pricing": [
        "billing", "charge", "cheap", "cost", "expensive", "free", "gold", "money", "overpriced", "paid",
        "pay", "plan", "platinum", "premium", "price", "purchase", "refund", "subscription",
        "worth",
    ],
    "Matches": [
        "algorithm", "boost", "compatible", "connection", "date", "discover", "explore", "like", "match",
        "partner", "passport", "profile", "recommend", "suggestion", "super like", "swipe",
    ],
    "Bugs": [
        "broken", "bug", "crash", "error", "fix", "force close", "freeze", "glitch", "hang", "lag",
        "laggy", "load", "not working", "slow", "stuck", "unresponsive", "update",
    ],
    "Safety": [
        "block", "bot", "catfish", "data", "fake", "genuine", "harassment", "identity", "privacy", "real",
        "report", "safety", "scam", "secure", "spam", "suspicious", "verification", "verify",
    ],
}

# English stop words.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below "
    "between both but by can did do does doing don down during each few for from further had has have "
    "having he her here hers herself him himself his how i if in into is it its itself just me more most "
    "my myself no nor not now of off on once only or other our ours ourselves out over own s same she "
    "should so some such t than that the their theirs them themselves then there these they this those "
    "through to too under until up very was we were what when where which while who whom why will with "
    "you your yours yourself yourselves"
).split()

# Default weights of the rule-based scorer; a caller may pass any other mapping.
SENTIMENT_WEIGHTS = {
    **dict.fromkeys("amazing awesome best excellent love loved perfect wonderful".split(), 2.0),
    **dict.fromkeys(
        "beautiful easy enjoy fast friendly fun genuine good great happy helpful intuitive nice recommend "
        "safe simple smooth useful worth".split(),
        1.0,
    ),
    **dict.fromkeys(
        "annoying bad boring bug bugs confusing crash crashes crashing error expensive freeze glitch lag "
        "laggy overpriced poor slow spam stuck ugly".split(),
        -1.0,
    ),
    **dict.fromkeys("awful broken fake hate horrible scam terrible useless waste worst".split(), -2.0),
}
