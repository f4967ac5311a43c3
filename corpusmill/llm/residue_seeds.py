"""What the residue models begin with: short texts made by rule.

Sources are public: the status phrases of the HTTP standard (as the standard library has them), the
messages that widely used servers, languages and publishing systems print, names of exceptions, the
syntaxes of template languages, the printers' filler text, and plain sentences put together from
parts. None is taken from a corpus; residue.fit() learns a corpus's own wording by itself.
"""

from __future__ import annotations

import builtins
from http import HTTPStatus
from itertools import product

# Messages that common servers, browsers, frameworks and languages print.
PRINTED = [
    "The requested URL was not found on this server.",
    "The requested URL was not found on the server. If you entered the URL manually please check your spelling and try again.",
    "You don't have permission to access this resource.",
    "The server encountered an internal error or misconfiguration and was unable to complete your request.",
    "Please contact the server administrator and inform them of the time the error occurred.",
    "More information about this error may be available in the server error log.",
    "The server is temporarily unable to service your request due to maintenance downtime or capacity problems.",
    "Your browser sent a request that this server could not understand.",
    "The resource you are looking for has been removed, had its name changed, or is temporarily unavailable.",
    "Sorry, the page you are looking for is currently unavailable.",
    "The page you were looking for doesn't exist. You may have mistyped the address or the page may have moved.",
    "We're sorry, but something went wrong.",
    "There has been a critical error on this website.",
    "Briefly unavailable for scheduled maintenance. Check back in a minute.",
    "It looks like nothing was found at this location.",
    "Error establishing a database connection",
    "Could not connect to the database server.",
    "You have an error in your SQL syntax; check the manual that corresponds to your server version near line 1",
    "Access denied for user 'web'@'localhost' (using password: YES)",
    "This site can't be reached. The server took too long to respond.",
    "Checking your browser before accessing the site.",
    "Backend fetch failed. Guru Meditation: XID: 12345",
    "No server is available to handle this request.",
    "upstream connect error or disconnect/reset before headers",
    "Warning: include(header.php): failed to open stream: No such file or directory in /home/www/index.php on line 12",
    "Warning: Undefined variable $user in /home/site/public/view.php on line 123",
    "Notice: Undefined index: page in /var/www/site/list.php on line 12",
    "Fatal error: Uncaught Error: Call to a member function get() on null in /var/www/app/page.php:123",
    "Fatal error: Call to undefined function load() in /srv/web/main.php on line 12",
    "Fatal error: Allowed memory size of 12345678 bytes exhausted (tried to allocate 12345 bytes)",
    "Parse error: syntax error, unexpected '}' in /var/www/site/post.php on line 12",
    "Deprecated: Function split() is deprecated in /home/www/lib.php on line 123",
    "Exception in thread \"main\" java.lang.RuntimeException: failed",
    "Caused by: java.io.IOException: Broken pipe",
    "at org.example.web.Page.render(Page.java:123)",
    "at com.example.Service.call(Service.java:12)",
    "Traceback (most recent call last):",
    "File \"/srv/app/views.py\", line 12, in render",
    "Uncaught TypeError: Cannot read properties of undefined (reading 'name')",
    "System.NullReferenceException: Object reference not set to an instance of an object.",
    "Server Error in '/' Application.",
    "Stack trace: #0 {main} thrown",
]
JAVA = ["NullPointer", "IllegalState", "IllegalArgument", "Runtime", "ClassCast", "IndexOutOfBounds", "Timeout", "SQL", "UnsupportedOperation", "NumberFormat"]
STATUS = ["{c} {p}", "{p}", "Error {c}", "Error {c}: {p}", "Error {c} - {p}", "HTTP Error {c} {p}", "HTTP {c} {p}", "HTTP {c} ({p})", "{c} - {p}", "{p} ({c})", "{p} (error {c})", "HTTP Status {c} - {p}", "{p}. {d}.", "Status: {c} {p}", "Sorry! {p} [{c}]", "Server returned {c} {p}."]
# Parts of the sentences below.
WHAT = ["the page", "this page", "the article", "the document", "the file", "the resource", "the content", "the address", "the link", "the post"]
ASKED = ["", " you requested", " you are looking for", " you were looking for", " you tried to reach", " you followed"]
MISSING = ["could not be found", "was not found", "cannot be found", "does not exist", "no longer exists", "has been moved", "has been removed", "has been deleted", "may have been moved or deleted", "may have been removed", "is not available", "is temporarily unavailable", "could not be loaded", "may be wrong", "is invalid"]
OOPS = ["", "oops! ", "sorry, ", "we're sorry, ", "error: "]
WRONG = ["something went wrong", "an error occurred", "an error has occurred", "an unexpected error occurred", "an internal error occurred", "we encountered an error", "we hit a problem", "there was a problem"]
WHILE = ["", " while processing your request", " while loading this page", " on our side", " with your request"]
RETRY = ["try again", "reload the page", "refresh the page", "check back", "come back", "retry", "wait"]
LATER = ["", " later", " in a few minutes", " in 12 seconds", " shortly", " soon"]
SERVICE = ["this site", "the site", "this website", "our website", "the server", "the service", "this page"]
DOWN = ["is down for maintenance", "is under maintenance", "is undergoing scheduled maintenance", "is temporarily down", "is currently unavailable", "is temporarily unavailable", "is overloaded", "is not responding", "is offline", "will be back soon", "is not available in your region"]
DENIED = ["access denied", "access forbidden", "permission denied", "you are not authorized to view this page", "you do not have permission to access this resource", "you do not have permission to view this directory", "your request was blocked", "your request has been blocked by the security system", "your address has been blocked", "this account has been suspended", "authentication required", "you must be logged in to view this page"]
SESSION = [f"{a} {b}" for a, b in product(["your session", "the session", "this link", "your login", "the token"], ["has expired", "expired", "has timed out", "is no longer valid", "is invalid"])]
AGAIN = ["please log in again", "please sign in again", "log in to continue", "sign in to continue"]
LIMIT = ["too many requests", "rate limit exceeded", "request limit reached", "you have sent too many requests", "please slow down"]
CONNECTION = [f"{a} {b}" for a, b in product(["connection", "request", "gateway", "server", "database connection", "upstream server", "the operation"], ["timed out", "timeout", "failed", "refused", "was reset", "was lost", "closed unexpectedly", "error"])]
NUMBER = [f"{a}{b}12345" for a, b in product(["error code", "error id", "reference", "reference number", "request id", "incident id", "support id", "ray id", "trace id", "ticket", "event id"], [": ", " ", " #"])]
LINKS = [f"{a} {b}" for a, b in product(["go back to", "return to", "back to", "visit"], ["the home page", "the homepage", "our home page", "the previous page", "the start page"])]
HELP = [f"{a} {b}{c}" for a, b, c in product(["contact", "please contact", "email"], ["the administrator", "the site administrator", "the webmaster", "support", "customer support", "the site owner"], ["", " if the problem persists", " for help"])]
CHECK = ["check the address", "check the url and try again", "check the spelling of the address", "make sure the address is correct", "you may have mistyped the address", "the address may be mistyped", "the link may be broken"]
NOTHING = ["no results", "no results found", "nothing found", "no articles found", "no posts found", "no content available", "invalid request", "invalid url", "invalid id 12345", "missing parameter", "invalid token"]
LOADING = ["loading", "loading...", "loading, please wait", "please wait while the page loads", "please wait...", "if the page does not load, check your connection"]
SCRIPTS = ["javascript", "java script", "scripts", "scripting", "js", "client-side scripting"]
PAGE = ["this site", "this website", "this page", "this app", "this application", "the site", "our website", "the page", "the content", "this article", "this form", "the video", "this feature"]
NEED = ["requires", "needs", "relies on", "depends on", "works best with", "does not work without", "will not work without", "cannot be displayed without", "cannot be viewed without", "may not function without", "is not available without", "will not load without"]
WITH = ["", " enabled", " to be enabled", " to work", " to function properly", " support", " turned on"]
STATE = ["is disabled", "is turned off", "is switched off", "is not enabled", "is not available", "is required", "must be enabled", "must be turned on", "seems to be disabled", "appears to be disabled", "has been disabled", "is blocked", "is not supported", "needs to be enabled"]
WHERE = ["", " in your browser", " by your browser", " on this device", " in your browser settings", " to use this site", " to view this page", " to continue", " to read on", " and reload the page", " and try again", " to see the content", " for this site"]
ASK = ["please", "you must", "you need to", "you have to", "to continue,", "to view this page,", "kindly", "for the best experience,"]
DO = ["enable", "turn on", "activate", "allow", "switch on"]
PLEAS = [
    "you need to enable javascript to run this app.", "we've detected that javascript is disabled in this browser.", "your browser does not support javascript.", "your browser has javascript disabled.",
    "for full functionality of this site it is necessary to enable javascript.", "here are the instructions how to enable javascript in your web browser.", "if you are seeing this message, scripts are disabled.",
    "allow scripts to run and reload.", "scripts are blocked, so the content is hidden.", "content is hidden until scripts are allowed.", "enable javascript and cookies to continue.", "switch to a supported browser to continue.", "please enable cookies.", "noscript",
]
#: The same in other languages: what fails, how, what to do about it, and scripts.
OTHERS = {
    "de": (["die seite", "die angeforderte seite", "die gesuchte seite", "der artikel", "diese adresse", "seite"], ["wurde nicht gefunden", "konnte nicht gefunden werden", "existiert nicht", "existiert nicht mehr", "ist nicht verfügbar", "nicht gefunden"], ["ein fehler ist aufgetreten", "interner serverfehler", "zugriff verweigert", "die sitzung ist abgelaufen", "wegen wartungsarbeiten nicht erreichbar", "zu viele anfragen"], ["bitte versuchen sie es später erneut", "bitte laden sie die seite neu", "zurück zur startseite"], ["bitte aktivieren sie javascript", "javascript ist deaktiviert", "diese seite benötigt javascript", "aktivieren sie javascript in ihrem browser"]),
    "fr": (["la page", "la page demandée", "la page que vous cherchez", "l'article", "cette adresse", "page"], ["est introuvable", "n'existe pas", "n'existe plus", "n'a pas été trouvée", "n'est pas disponible", "introuvable", "non trouvée"], ["une erreur est survenue", "erreur interne du serveur", "accès refusé", "votre session a expiré", "site en maintenance", "trop de requêtes"], ["veuillez réessayer plus tard", "veuillez recharger la page", "retour à l'accueil"], ["veuillez activer javascript", "javascript est désactivé", "ce site nécessite javascript", "activez javascript dans votre navigateur"]),
    "es": (["la página", "la página solicitada", "la página que busca", "el artículo", "esta dirección", "página"], ["no se ha encontrado", "no existe", "ya no existe", "no está disponible", "no pudo ser encontrada", "no encontrada"], ["se ha producido un error", "error interno del servidor", "acceso denegado", "su sesión ha caducado", "sitio en mantenimiento", "demasiadas solicitudes"], ["inténtelo de nuevo más tarde", "vuelva a cargar la página", "volver al inicio"], ["por favor, active javascript", "javascript está desactivado", "este sitio requiere javascript", "habilite javascript en su navegador"]),
    "it": (["la pagina", "la pagina richiesta", "la pagina che cerchi", "l'articolo", "pagina"], ["non è stata trovata", "non esiste", "non esiste più", "non è disponibile", "non trovata"], ["si è verificato un errore", "errore interno del server", "accesso negato", "la sessione è scaduta", "sito in manutenzione", "troppe richieste"], ["riprova più tardi", "ricarica la pagina", "torna alla home page"], ["attiva javascript", "javascript è disattivato", "questo sito richiede javascript", "abilita javascript nel browser"]),
    "pt": (["a página", "a página solicitada", "a página que procura", "o artigo", "página"], ["não foi encontrada", "não existe", "já não existe", "não está disponível", "não encontrada"], ["ocorreu um erro", "erro interno do servidor", "acesso negado", "a sua sessão expirou", "site em manutenção", "pedidos em excesso"], ["tente novamente mais tarde", "recarregue a página", "voltar à página inicial"], ["por favor, ative o javascript", "o javascript está desativado", "este site requer javascript", "habilite o javascript no seu navegador"]),
    "nl": (["de pagina", "de gevraagde pagina", "de pagina die u zoekt", "het artikel", "pagina"], ["is niet gevonden", "kon niet worden gevonden", "bestaat niet", "bestaat niet meer", "is niet beschikbaar", "niet gevonden"], ["er is een fout opgetreden", "interne serverfout", "toegang geweigerd", "uw sessie is verlopen", "site in onderhoud", "te veel verzoeken"], ["probeer het later opnieuw", "laad de pagina opnieuw", "terug naar de startpagina"], ["schakel javascript in", "javascript is uitgeschakeld", "deze site vereist javascript", "zet javascript aan in uw browser"]),
    "sv": (["sidan", "sidan du söker", "artikeln"], ["kunde inte hittas", "finns inte", "finns inte längre", "är inte tillgänglig"], ["ett fel har uppstått", "internt serverfel", "åtkomst nekad", "din session har gått ut"], ["försök igen senare", "ladda om sidan", "till startsidan"], ["aktivera javascript", "javascript är inaktiverat", "denna sida kräver javascript"]),
    "pl": (["strona", "żądana strona", "artykuł"], ["nie została znaleziona", "nie istnieje", "jest niedostępna"], ["wystąpił błąd", "wewnętrzny błąd serwera", "odmowa dostępu", "sesja wygasła"], ["spróbuj ponownie później", "odśwież stronę", "powrót do strony głównej"], ["włącz javascript", "javascript jest wyłączony", "ta strona wymaga javascript"]),
}
FIELDS = ["name", "first_name", "lastName", "user", "user.name", "email", "phone", "address", "city", "country", "company", "product", "price", "amount", "date", "year", "title", "page.title", "author", "subject", "url", "image_url", "item.id", "order-id", "field1", "nom", "número"]
#: Slots of common template languages, by delimiters; {f} is a field, {w} its words.
SLOTS = ["{{{{{f}}}}}", "{{{{ {f} }}}}", "{{{{{{{f}}}}}}}", "{{{{ {f} | upper }}}}", '{{{{ {f} | default: "-" }}}}', "{{% if {f} %}}", "{{% block {f} %}}", "{{% endif %}}", "{{{f}}}", "#{{{f}}}", "${{{f}}}", "<%= {f} %>", "<% {f} %>", "<?= ${f} ?>", "@@{f}@@", "%{f}%", "%%{f}%%", "${f}$", "__{f}__", "[[{f}]]", "[%{f}%]", "*|{f}|*", "%({f})s", "[{w}]", "[your {w}]", "[your {w} here]", "[insert {w}]", "[insert {w} here]", "[enter {w}]", "<your {w}>", "<insert {w}>", "&lt;{w}&gt;", "&lt;your {w}&gt;"]
AROUND = ["{s}", "dear {s},", "hello {s},", "hi {s}!", "thank you for your order, {s}.", "welcome to {s}", "by {s} on {s}", "copyright {s} {s}", "regards, {s}", "published on {s}", "price: {s}", "{s}: {s}", " {s} "]
LOREM = "lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum."
STAND_INS = (
    [f"{a} your {b} here" for a, b in product(["insert", "add", "enter", "type", "put", "write", "place"], ["text", "content", "title", "description", "headline", "bio", "message", "caption"])]
    + [f"{a} {b} {c}" for a, b, c in product(["this is", "here goes", "just some"], ["sample", "placeholder", "dummy", "example", "filler", "default"], ["text", "content", "paragraph", "post", "page", "copy"])]
    + [f"{a} {b}" for a, b in product(["your", "sample", "placeholder", "dummy", "default"], ["text here", "content here", "title goes here", "text goes here", "headline here", "description"])]
    + ["content coming soon", "description coming soon", "to be added", "to be written", "text to follow", "more text here", "tbd", "todo: write this", "xxx", "untitled document", "hello world! this is your first post. edit or delete it, then start writing!", "the quick brown fox jumps over the lazy dog", "hier steht ihr text", "platzhaltertext", "votre texte ici", "texte à venir", "su texto aquí", "texto de ejemplo", "testo segnaposto", "uw tekst hier"]
)

#: Plain sentences for the model of prose, which the corpus adds to.
PROSE = """
She put the letter back into the drawer and went out to feed the hens.
After the storm the farmers walked along the dike to see what the water had taken.
The committee met twice in March, but neither meeting came to a decision about the harbour.
Most of the words in this dictionary came from sailors, and some were written down only once.
If the dough feels too wet, add a spoonful of flour and let it rest for another ten minutes.
In dry summers the lake shrinks so far that the foundations of the old mill can be seen.
The museum reopened last week with a show of early radios and the people who built them.
Cells divide when a signal reaches the nucleus, and errors in that signal may lead to disease.
Nobody in the village remembered who had planted the chestnut, though everyone had climbed it.
The price of copper rose again in the second half of the year, as the mines in the north were closed.
Two engineers checked the dam every morning and wrote the level of the water on a board.
Migrating birds rest on the island for a few days before they cross the strait.
In the afternoon the children found an address written on the back of a photograph.
The train was late because a tree had fallen across the track near the second bridge.
They moved the piano through the window, since the stairs were too narrow for it.
The teacher explained that water expands when it freezes, which is why pipes burst in cold weather.
Several readers wrote that the article had left out the part played by the unions.
Fresh bread, salt and a little oil were all that the travellers needed for their supper.
The band played until midnight; then the lights went out and everybody walked home along the river.
You can see from the figure that the two species differ in the shape of their wings.
The council said that the library would stay open on Saturdays, at least until the autumn.
When the king died without an heir, three of his cousins claimed the throne at once.
Our neighbours have a dog that barks at the post van and at nothing else.
For many years the town was known for its clocks, and people came from far away to buy them.
Wir gingen am Morgen über die Felder, und als der Nebel sich hob, sahen wir zum ersten Mal das Meer.
Der Bäcker hatte schon geschlossen, aber seine Frau gab uns noch ein Brot aus dem Fenster.
Die meisten Häuser in dieser Straße wurden nach dem Krieg gebaut, nur die Schule ist älter.
Le soir, ils s'asseyaient devant la maison et parlaient de la récolte et du temps qu'il ferait.
Cette rivière prend sa source dans les montagnes et traverse trois départements avant la mer.
Los pescadores volvieron antes del amanecer con las redes vacías y muchas historias que contar.
La ciudad creció alrededor del mercado, que todavía se celebra todos los jueves en la plaza.
Il medico del paese conosceva tutti per nome e non chiedeva mai denaro ai più poveri.
""".strip().split("\n")


def _even(lines: list[str], n: int) -> list[str]:
    """n of the lines, evenly over the list, which is repeated if it is shorter."""
    return [lines[k * len(lines) // n] for k in range(n)]


def _sentences(*parts: list[str]) -> list[str]:
    return ["".join(p) + "." for p in product(*parts)]


def notices(each: int = 400) -> list[str]:
    """About `each` lines of every kind of notice, so that no kind outweighs the others."""
    status = [t.format(c=int(s), p=s.phrase, d=s.description or s.phrase) for s in HTTPStatus if s >= 400 for t in STATUS]
    errors = [f"{n}: {m}" for n in dir(builtins) if n.endswith("Error") for m in ("'name' is not defined", "invalid value", "list index out of range")]
    errors += [f"{p}{n}Exception{m}" for n in JAVA for p in ("java.lang.", "Caused by: java.lang.", "org.example.") for m in ("", ": null", ": failed at Page.render(Page.java:123)", " at Server.handle(Server.java:12)")]
    kinds = [
        status, PRINTED, errors,
        _sentences(OOPS, [w + a for w, a in product(WHAT, ASKED)], [" "], MISSING), _sentences(OOPS, WRONG, WHILE), _sentences(["please ", "kindly ", ""], RETRY, LATER), _sentences(SERVICE, [" "], DOWN),
        [f"{d}{e}" for d, e in product(DENIED, ["", ".", ". reference 12345"])], _sentences(SESSION, [". "], AGAIN), LIMIT + CONNECTION, NUMBER, LINKS + HELP + CHECK, NOTHING + LOADING,
        [f"{a} {n} {s}{w}." for a, n, s, w in product(PAGE, NEED, SCRIPTS, WITH)], [f"{s} {v}{w}." for s, v, w in product(SCRIPTS, STATE, WHERE)], [f"{a} {d} {s}{w}." for a, d, s, w in product(ASK, DO, SCRIPTS, WHERE)], PLEAS,
    ]
    for what, missing, wrong, retry, scripts in OTHERS.values():
        kinds.append([f"{a} {b}{c}" for a, b, c in product(what, missing, [".", " (404)."])] + [f"{a}. {b}." for a, b in product(wrong, retry)] + [f"{a}{b}" for a, b in product(scripts, [".", ", " + retry[0] + "."])])
    return [x for lines in kinds for x in _even(lines, each)]


def fillers() -> list[str]:
    """The filler text in many orders of its words, stand-ins and slots."""
    from corpusmill.llm.quality import FILLER

    words = sorted(FILLER)
    n = len(words)
    out = [LOREM] * 20
    out += [" ".join(words[(k * step + step) % n] for k in range(8)) + "." for step in range(1, n)]  # every word before many others
    slots = [s.format(f=f, w=f.replace("_", " ")) for s, f in product(SLOTS, FIELDS)]
    return out + [a.format(s=s) for a, s in product(AROUND, slots)] + STAND_INS * 3
