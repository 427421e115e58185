"""Word and phrase lists by language, thresholds and other tables: fixed values that users may replace."""

# Fixed values, in natural order: what the rules compare with.
GREETINGS = {
    "pl": ["cześć", "hej", "siema", "witam", "witaj", "dzień dobry", "dobry wieczór", "ok", "okej"],
    "en": ["hi", "hello", "hey", "good morning", "good evening", "good afternoon", "ok", "okay"],
}
THANKS = {
    "pl": ["dziękuję", "dzięki", "dziękuję bardzo", "wielkie dzięki", "super dzięki", "pomogło", "to pomogło", "bardzo pomogło"],
    "en": ["thanks", "thank you", "thanks a lot", "thank you very much", "that helped", "thanks that helped"],
}
META = {
    "pl": ["kim jesteś", "kim ty jesteś", "co potrafisz", "w czym możesz pomóc", "w czym możesz mi pomóc", "czym się zajmujesz", "co robisz", "czy jesteś botem", "czy jesteś człowiekiem", "jesteś botem", "jesteś sztuczną inteligencją", "do czego służysz"],
    "en": ["who are you", "what can you do", "how can you help", "what are you", "are you a bot", "are you human", "are you an ai"],
}
CONTROL = {
    "pl": {
        "prosciej": ["nie rozumiem", "nie zrozumiałem", "nie zrozumiałam", "możesz prościej", "prościej", "wytłumacz prościej", "nie rozumiem tego", "jak to inaczej", "wyjaśnij prościej"],
        "rozwin": ["rozwiń", "rozwiń to", "rozwiń temat", "powiedz więcej", "opowiedz więcej", "więcej szczegółów", "rozszerz to"],
        "potwierdzenie": ["tak", "no tak", "dobra", "jasne", "zgadza się", "no dobra", "ok", "okej"],
    },
    "en": {
        "prosciej": ["i don't understand", "i do not understand", "simpler please", "can you simplify", "explain simpler", "i didn't understand"],
        "rozwin": ["expand", "expand on that", "tell me more", "more details", "go deeper"],
        "potwierdzenie": ["yes", "yeah", "yep", "sure", "alright"],
    },
}
PRONOUNS = {"pl": ["to", "tego", "tym", "tam", "ten", "ta", "te", "nim", "niej", "nich"], "en": ["it", "that", "this", "those", "them", "one"]}
FOLLOWUP_PREFIXES = {"pl": ["a "], "en": ["and ", "what about", "how about", "what if"]}
MAIL_VERBS = {"pl": ["napisz", "napiszesz", "napisać", "przygotuj", "przygotować", "pomóż", "pomoz", "pomożesz"], "en": ["write", "draft", "prepare", "help"]}
MAIL_OBJECTS = {
    "pl": ["mail", "maila", "maile", "mailu", "meila", "wiadomość", "wiadomosc", "wiadomości", "reklamacja", "reklamację", "reklamacje", "reklamacji", "reklamacyjny", "reklamacyjnego", "reklamacyjną", "zwrot", "zwrotu", "fakturę", "fakturze", "fakturą"],
    "en": ["email", "e-mail", "mail", "message", "complaint", "return", "invoice", "receipt"],
}
MAIL_CATEGORIES = {
    "pl": {
        "reklamacja": {"words": ["uszkodzony", "uszkodzone", "uszkodzona", "wadliwy", "wadliwe", "wadliwa", "wada", "zepsuty", "zepsute", "zepsuta", "reklamacja", "reklamację", "reklamacje", "reklamacji", "reklamować", "oszukany", "oszukana", "niezgodny", "niezgodne"], "phrases": ["nie dziala", "nie działa"], "offer": "Przygotuj proszę szkic maila reklamacyjnego do sprzedawcy."},
        "zwrot": {"words": ["zwrot", "zwrotu", "zwrócić", "zwrocic", "odstąpienie", "odstapienie", "odstąpić", "odstapic"], "phrases": ["chce oddac towar", "chcę oddać towar", "chce zwrocic", "chcę zwrócić"], "offer": "Przygotuj proszę szkic wiadomości o zwrocie produktu."},
        "faktura": {"words": ["faktura", "fakturę", "faktury", "fakturze", "fakturą", "fakture"], "phrases": [], "offer": "Przygotuj proszę szkic prośby o fakturę."},
        "eskalacja": {"words": [], "phrases": ["nie odpowiada", "odmawia pomocy", "odmawia zwrotu", "nie przyszła", "nie przyszla", "nie dotarła", "nie dotarla", "nie dostałem", "nie dostalem", "nie dostałam", "nie dostalam", "zaginęła", "zaginela"], "offer": "Przygotuj proszę szkic wiadomości z prośbą o zaangażowanie platformy."},
    },
    "en": {
        "reklamacja": {"words": ["damaged", "defective", "broken", "faulty", "complaint", "complaints", "scam", "scammed"], "phrases": ["isn't working", "is not working"], "offer": "Please prepare a draft complaint email to the seller."},
        "zwrot": {"words": ["return", "refund", "withdraw"], "phrases": ["want to return", "want a refund"], "offer": "Please prepare a draft message about returning the product."},
        "faktura": {"words": ["invoice", "receipt"], "phrases": [], "offer": "Please prepare a draft invoice request."},
        "eskalacja": {"words": ["unresponsive"], "phrases": ["not responding", "not responded", "hasn't responded", "has not responded", "refuses to help", "refuses a refund", "never arrived", "hasn't arrived", "has not arrived", "didn't arrive", "did not arrive", "lost package"], "offer": "Please prepare a draft message asking the platform to get involved."},
    },
}
SIDE_MARKERS = {
    "kupujacy": {"words": ["kupiłem", "kupilem", "kupiłam", "kupilam", "zamówiłem", "zamowilem", "zamówiłam", "zamowilam", "zamówienie", "zamowienie", "zamówienia", "zamowienia", "zamówień", "zamowien", "przesyłka", "przesylka", "przesyłkę", "przesylke", "przesyłki", "przesylki", "paczka", "paczke", "paczkę", "paczki"], "phrases": ["moja przesyłka", "moja przesylka", "moje zamówienie", "moje zamowienie", "sprzedawca nie", "moja paczka"]},
    "sprzedajacy": {"words": ["sprzedaję", "sprzedaje", "sprzedajesz", "wystawiam", "wystawiłem", "wystawilem", "wystawić", "wystawic", "prowizja", "prowizję", "prowizje", "prowizji", "wypłata", "wyplata", "wypłatę", "wyplate", "wypłaty", "wyplaty", "aukcje", "aukcja", "aukcji"], "phrases": ["moja oferta", "moje oferty", "mój kupujący", "moj kupujacy", "moi kupujący", "moi kupujacy", "moje aukcje", "wystawić przedmiot", "wystawic przedmiot", "moja sprzedaż", "moja sprzedaz", "mój sklep", "moj sklep"]},
}
DONT_KNOW = {
    "pl": ["nie mam informacji", "brak informacji w kontekście", "nie znalazłem w materiałach", "nie zawiera informacji", "nie ma informacji"],
    "en": ["i do not have information", "no information in the context", "i couldn't find this in the materials"],
}
EXPLICIT_REFUSALS = {
    "pl": ["nie mogę udzielić odpowiedzi", "nie mogę odpowiedzieć na to pytanie"],
    "en": ["i can't answer this question", "i cannot answer this question"],
}
# Fixed patterns, matched on text without accents in lower case.
INJECTIONS = [
    r"\b(?:z)?ignoruj\w*(?:\s+\w+){0,3}\s+(?:instrukcj|polecen|wytyczn|zasad|regul)",
    r"\bzapomnij(?:\s+\w+){0,3}\s+(?:instrukcj|polecen|wytyczn|zasad)",
    r"\b(?:pomin|omin|zignoruj)\w*(?:\s+\w+){0,3}\s+(?:instrukcj|polecen|wytyczn)",
    r"\b(?:ignore|disregard|forget|override|bypass|skip)(?:\s+\w+){0,3}\s+(?:previous|prior|above|earlier|all|any|your|system|instruction|rule)",
    r"\b(?:system|systemow\w*)\s*prompt",
    r"\bprompt\w*\s+systemow",
    r"\b(?:nowa|nowe)\s+instrukcj\w*(?:\s+\w+){0,3}\s+(?:system\w*|model\w*|prompt\w*|asystent\w*)",
    r"\bnew\s+(?:instruction|system)",
    r"\bact\s+as\b",
    r"\budawaj\b",
    r"\bpretend\s+(?:to\s+be|you|that)",
    r"\bjailbreak",
    r"\bdan\s+mode\b",
    r"\b(?:reveal|show|print|repeat)(?:\s+\w+){0,2}\s+(?:prompt|instruction|system)",
    r"\bpoka[zż]\w*(?:\s+\w+){0,3}\s+(?:prompt|instrukcj)",
]
GUARD_MESSAGES = {
    "pl": {"za_krotkie": "Napisz proszę pełne pytanie.", "za_dlugie": "Pytanie jest za długie, opisz jeden problem na raz.", "nie_rozumiem": "Nie rozumiem pytania. Czy możesz napisać je inaczej?", "zly_alfabet": "Napisz proszę pytanie po polsku.", "injekcja": "Mogę pomóc tylko w sprawach zakupów, konta i płatności."},
    "en": {"za_krotkie": "Please write a complete question.", "za_dlugie": "The question is too long, please describe one issue at a time.", "nie_rozumiem": "I don't understand the question. Could you phrase it differently?", "zly_alfabet": "Please write your question in English.", "injekcja": "I can only help with shopping, account, and payment questions."},
}
RERANK_THRESHOLD = {"pl": -5.7, "en": -3.6}
COVERAGE_THRESHOLD = {"pl": 0.20, "en": 0.35}
SIDES = ["kupujacy", "sprzedajacy"]
SELLER_SECTION = "sprzedaz"
DIAGNOSES = {"prog_rerank": "retrieval", "sedzia": "sedzia", "pokrycie": "pokrycie", "model_nie_wie": "generacja", "jawna_odmowa": "generacja", "brak_generacji": "generacja", "nie_zrozumialem": "literowki", "pytanie_o_strone": "doprecyzowanie"}
EXPORT_COLUMNS = ["czas", "lang", "strona", "sekcja", "wynik", "powod", "powod_etap2", "latencja_s", "cache_hit", "pytanie", "tokeny_we", "tokeny_wy", "koszt_usd"]
EXPORT_DEFAULT = ["czas", "lang", "strona", "sekcja", "wynik", "powod", "latencja_s", "cache_hit"]
LATENCY_EDGES = [2.0, 5.0, 10.0, 20.0]
LATENCY_LABELS = ["0 do 2 s", "2 do 5 s", "5 do 10 s", "10 do 20 s", "ponad 20 s"]
CHARS_PER_TOKEN = 3.6
