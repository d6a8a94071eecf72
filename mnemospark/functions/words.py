"""Word lists and patterns of the rules. Results depend on each of them."""

# Whole texts that say nothing.
FILLER = ("ok", "k", "fine", "sure", "yes", "no", "hey", "hi", "hello", "thanks", "thx", "cool", "nice", "yo", "okay", "okey", "kk", "got it", "sounds good", "will do")
# Next to a digit, private data.
CONTACT = ("number", "phone", "mobile", "ssn", "otp", "card", "account", "address", "email", "passcode", "password")
# Dates and times.
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "weekday", "weekdays")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "spring", "summer", "autumn", "winter")
OTHER_DAYS = ("today", "tomorrow", "yesterday", "tonight", "holiday", "holidays")
ORDINALS = (
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth",
    "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth", "twenty-first", "thirtieth", "thirty-first", "last",
)
TERM_ENDS = ("end of quarter", "last day of term", "end of term")
CLOCK = r"\p{Nd}|o'clock|half past|quarter (to|past)"
# What is costly to forget.
OBLIGATION = ("deadline", "renewal", "filing", "expiry", "expire", "cutoff", "due date", "enrollment")
LEGAL = ("visa", "passport", "court", "custody", "hearing", "immigration", "asylum")
PROCEDURE = ("interview", "papers", "paperwork", "office", "notice")
JEOPARDY = ("evict", "forfeit", "foreclos", "repossess", "nonrefundable", "overdraft")
ACUTE = ("epinephrine", "epipen", "anaphylaxis", "insulin", "inhaler", "seizure", "overdose", "bacteria", "contaminat", "poison", "allerg")
CARE = ("pill", "pills", "medication", "dose", "prescription", "antibiotic")
HARM = r"or (she|he|they|it|you) (faint|faints|collapse|collapses|die|dies|seize|seizes|choke)"
STOP_LOSS = ("stop-loss", "stoploss", "stop loss")
LIMIT_UNITS = ("lots", "percent", "%")
# Standing facts.
ROUTINE = ("prefer", "standup", "always", "never", "slot", "daily", "weekly")
RECURRENCE = ("visit", "trip", "morning", "evening")
SCHEDULE = ("opens", "closes", "leaves", "meets", "runs", "starts", "resets", "clears", "moved", "moves")
CAPACITY = ("terabyte", "terabytes", "gigabyte", "gigabytes", "megabyte", "seat", "seats", "capacity", "an hour", "per hour", "twice a", "per visit", "tenth visit")
KEPT = ("key", "keys", "charger", "adapter", "wallet", "documents", "drive", "notes", "contact", "medication", "remote", "router")
LOCATIVE = ("hangs", "lies", "sits", "lives", "live", "waits", "behind", "under", "inside", "above")
RECORD = ("birthday", "anniversary")
# Revisions of facts.
NEGATION = ("no longer", "not", "never", "anymore", "stopped", "quit", "hate", "gave up", "dropped", "gone")
STRONG = ("moved", "relocated", "renamed", "changed", "updated", "is now", "now at", "address is")
WEAK = ("now", "update", "latest", "new")
# Tokens without content.
FUNCTION_WORDS = (
    "a", "an", "the", "i", "we", "you", "he", "she", "it", "they", "is", "are", "was", "were", "be", "been", "am", "at", "in", "on", "of", "to", "for", "with", "by", "from", "as",
    "and", "or", "but", "so", "if", "then", "than", "that", "this", "do", "does", "did", "not", "no", "my", "our", "your", "has", "have", "had",
)
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen",
    "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "first", "second", "third",
)
RELATIONS = ("same", "supersede", "conflict_unresolved", "contradict", "coexist", "unrelated")
SPLIT_FIELDS = ("split", "tuned_on", "trained_on", "train_on", "fitted_on")
SUITES = ("admit", "importance", "dedupe", "contradict", "supersede", "rerank")
