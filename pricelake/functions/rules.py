"""Fixed rule tables. Results depend on these exact values."""

from __future__ import annotations

# ---- fixed values: URL clean-up ------------------------------------------------------------
BREADCRUMB_CHARS = "›‹»«"

TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term",
    "ref", "referer", "source", "campaign", "fbclid", "gclid", "dclid",
    "_ga", "_gac", "mc_cid", "mc_eid", "affiliate", "partner", "srsltid",
]

# ---- fixed values: product URL heuristic ---------------------------------------------------
PRODUCT_EXCLUDE_TOKENS = [
    "wikipedia.org", "evisos.com.uy", "foodbevg.com", "acg.com.uy",
    "/search", "/busca", "/resultados", "/results", "/category/", "/categories/",
    "/collections/", "/collection/", "/list/", "/filtros", "/filters", "/ordenar", "/sort",
    "javascript:", "mailto:", "#", "/account", "/login", "/register", "/contact", "/about",
    "/politica", "/terminos", "/help", "/ayuda", "/cart", "/checkout", "/wishlist",
]
PRODUCT_PAGING_TOKENS = ["?page=", "&page=", "?q=", "?search=", "&q=", "?sort=", "&sort="]
PRODUCT_STRONG_TOKENS = [
    "/p/", "/product/", "/producto/", "/item/", "/sku/", "/prod/", ".producto",
    "/products/", "/articulo/", "/art/", "/dp/", "/gp/product/", "/i/",
]
SINGLE_PRODUCT_PATTERNS = [
    r"/producto/", r"/product/", r"/productos/", r"/item/", r"/dp/", r"/articulo/", r"/sku/",
    r"/p$", r"/p\?", r"/p/", r"\.producto\?", r"-\d{5,}/p$",
    r"[?&](id|sku|product_id|productid|item)=",
]

# ---- fixed values: marketplace site rules --------------------------------------------------
MARKETPLACE_DOMAIN = "mercadolibre.com.uy"
MARKETPLACE_LISTING_HOST = "listado.mercadolibre.com.uy"
MARKETPLACE_PRODUCT_HOST = "articulo.mercadolibre.com.uy"
MARKETPLACE_MAIN_HOSTS = ["www.mercadolibre.com.uy", "mercadolibre.com.uy"]
MARKETPLACE_LINK_HOSTS = [
    "listado.mercadolibre.com.uy", "articulo.mercadolibre.com.uy",
    "www.mercadolibre.com.uy", "mercadolibre.com.uy",
]

# ---- fixed values: candidate filters -------------------------------------------------------
BLOCKED_DOMAINS = [
    "tiendaviajes.com.uy", "viajes.com.uy", "despegar.com.uy", "booking.com", "tripadvisor.com",
    "gallito.com.uy", "infocasas.com.uy", "inmuebles.com.uy",
    "elpais.com.uy", "montevideo.com.uy", "subrayado.com.uy", "elobservador.com.uy", "ladiaria.com.uy",
    "buscojobs.com.uy", "computrabajo.com.uy", "empleos.com.uy",
    "facebook.com", "instagram.com", "twitter.com", "linkedin.com", "pinterest.com", "youtube.com",
    "wikipedia.org", "gub.uy",
]
EXCLUDE_SEGMENTS = [
    "ayuda", "help", "support", "contacto", "contact", "blog", "news", "noticias", "faq", "terms",
    "privacy", "politicas", "about", "acerca", "nosotros", "quienes-somos", "legal", "cookies",
    "glossary", "glosario", "sitemap",
    "login", "signin", "register", "signup", "mi-cuenta", "my-account", "profile", "perfil",
    "dashboard", "admin", "checkout", "cart", "carrito", "wish", "favoritos",
    "api", "ajax", "json", "xml", "rss", "feed", "autocomplete", "suggest", "search-suggest",
    "browse", "explorar", "directory", "directorio",
]
EXCLUDE_LISTING_PATTERN = r"^[^/]+/(?:categories?|categorias?|sections?|secciones?)/?$"
EXCLUDE_EXTENSIONS = [
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "exe", "dmg",
    "jpg", "jpeg", "png", "gif", "svg", "webp", "mp4", "mp3", "wav",
]
PRIORITY_PATTERNS = [
    r"/p/[A-Z]{3}\d+", r"/product/", r"/producto/", r"/item/", r"/articulo/",
    r"/dp/[A-Z0-9]+", r"/gp/product/", r"/products?/[^/]+$",
]

# ---- fixed values: blocked result pages ----------------------------------------------------
BLOCKED_HTML_MARKERS = [
    "captcha", "verify you are", "unusual traffic", "enable javascript", "robot check", "access denied",
]
BLOCKED_TEXT_MARKERS = ["captcha", "verify you are", "unusual traffic", "robot", "access denied"]

# ---- fixed values: search engines ----------------------------------------------------------
ENGINE_TEMPLATES = [
    ("duckduckgo", "https://html.duckduckgo.com/html/?q=", ""),
    ("startpage", "https://www.startpage.com/sp/search?q=", "&cat=web&language=english"),
    ("ecosia", "https://www.ecosia.org/search?q=", ""),
    ("qwant", "https://www.qwant.com/?q=", "&t=web"),
]
GOOGLE_TEMPLATE = ("google", "https://www.google.com/search?q=", "&num=20")
PROBE_ORDER_ALL_OPEN = ["ecosia", "qwant", "startpage", "duckduckgo", "google"]
PROBE_ORDER_ONE_LEFT = ["qwant", "ecosia", "startpage", "duckduckgo", "google"]

# ---- fixed values: geography ---------------------------------------------------------------
COUNTRY_ALIASES = {
    "UY": "UY", "URUGUAY": "UY",
    "AR": "AR", "ARGENTINA": "AR",
    "BR": "BR", "BRAZIL": "BR", "BRASIL": "BR",
    "CL": "CL", "CHILE": "CL",
    "CO": "CO", "COLOMBIA": "CO",
    "PE": "PE", "PERU": "PE",
    "EC": "EC", "ECUADOR": "EC",
    "MX": "MX", "MEXICO": "MX",
    "US": "US", "USA": "US", "UNITED STATES": "US",
    "ES": "ES", "SPAIN": "ES", "ESPAÑA": "ES",
}
COUNTRY_CITIES = {
    "UY": ["MONTEVIDEO", "PUNTA DEL ESTE", "COLONIA", "SALTO", "PAYSANDU", "MALDONADO"],
    "AR": ["BUENOS AIRES", "CORDOBA", "ROSARIO", "MENDOZA", "LA PLATA", "MAR DEL PLATA"],
    "BR": ["SAO PAULO", "RIO DE JANEIRO", "BRASILIA", "SALVADOR", "FORTALEZA", "BELO HORIZONTE"],
    "CL": ["SANTIAGO", "VALPARAISO", "CONCEPCION", "VINA DEL MAR", "ANTOFAGASTA", "TEMUCO"],
    "CO": ["BOGOTA", "MEDELLIN", "CALI", "BARRANQUILLA", "CARTAGENA", "BUCARAMANGA"],
    "PE": ["LIMA", "AREQUIPA", "TRUJILLO", "CHICLAYO", "PIURA", "CUSCO"],
    "EC": ["QUITO", "GUAYAQUIL", "CUENCA", "AMBATO", "MANTA", "MACHALA"],
    "MX": ["MEXICO CITY", "GUADALAJARA", "MONTERREY", "PUEBLA", "TIJUANA", "CANCUN"],
    "US": ["NEW YORK", "LOS ANGELES", "CHICAGO", "HOUSTON", "PHOENIX", "PHILADELPHIA"],
    "ES": ["MADRID", "BARCELONA", "VALENCIA", "SEVILLA", "ZARAGOZA", "MALAGA"],
}
COUNTRY_TLDS = {
    "UY": [".uy", ".com.uy", ".edu.uy", ".gub.uy", ".org.uy", ".net.uy"],
    "AR": [".ar", ".com.ar", ".edu.ar", ".gob.ar", ".org.ar", ".net.ar"],
    "BR": [".br", ".com.br", ".edu.br", ".gov.br", ".org.br", ".net.br"],
    "CL": [".cl", ".com.cl", ".edu.cl", ".gob.cl", ".org.cl", ".net.cl"],
    "CO": [".co", ".com.co", ".edu.co", ".gov.co", ".org.co", ".net.co"],
    "PE": [".pe", ".com.pe", ".edu.pe", ".gob.pe", ".org.pe", ".net.pe"],
    "EC": [".ec", ".com.ec", ".edu.ec", ".gob.ec", ".org.ec", ".net.ec"],
    "MX": [".mx", ".com.mx", ".edu.mx", ".gob.mx", ".org.mx", ".net.mx"],
    "US": [".us", ".com", ".edu", ".gov", ".org", ".net"],
    "ES": [".es", ".com.es", ".edu.es", ".gob.es", ".org.es", ".net.es"],
}
COUNTRY_SHOPS = {
    "UY": ["mercadolibre.com.uy", "tiendainglesa.com.uy", "devoto.com.uy", "farmacity.com.uy",
           "disco.com.uy", "geant.com.uy", "zonaamerica.com", "puntashop.com", "lider.com.uy"],
    "AR": ["mercadolibre.com.ar", "pedidosya.com.ar", "tiendamia.com.ar", "falabella.com.ar",
           "garbarino.com", "fravega.com"],
    "BR": ["mercadolivre.com.br", "americanas.com.br", "submarino.com.br", "magazineluiza.com.br",
           "casasbahia.com.br", "extra.com.br"],
    "CL": ["mercadolibre.cl", "falabella.com", "ripley.cl", "lider.cl", "paris.cl", "sodimac.cl"],
    "CO": ["mercadolibre.com.co", "falabella.com.co", "exito.com", "alkosto.com", "linio.com.co",
           "homecenter.com.co"],
    "PE": ["mercadolibre.com.pe", "falabella.com.pe", "ripley.com.pe", "wong.pe", "tottus.com.pe",
           "plazavea.com.pe"],
    "EC": ["mercadolibre.com.ec", "de-una.com", "megamaxi.com", "supermaxi.com", "tia.com.ec",
           "comandato.com"],
    "MX": ["mercadolibre.com.mx", "amazon.com.mx", "liverpool.com.mx", "elektra.com.mx", "coppel.com",
           "soriana.com"],
    "US": ["amazon.com", "walmart.com", "target.com", "bestbuy.com", "homedepot.com", "lowes.com"],
    "ES": ["amazon.es", "elcorteingles.es", "carrefour.es", "mediamarkt.es", "worten.es", "fnac.es"],
}
COUNTRY_HOST_WORDS = {
    "UY": ["uruguay", "uy", "montevideo"],
    "AR": ["argentina", "ar", "buenosaires", "argentina.com"],
    "BR": ["brasil", "brazil", "br", "saopaulo"],
    "CL": ["chile", "cl", "santiago"],
    "CO": ["colombia", "co", "bogota"],
    "PE": ["peru", "pe", "lima"],
    "EC": ["ecuador", "ec", "quito"],
    "MX": ["mexico", "mx", "mexicocity"],
    "US": ["usa", "us", "america"],
    "ES": ["espana", "spain", "es", "madrid"],
}
COUNTRY_PATH_WORDS = {
    "UY": ["/uruguay/", "/uy/", "/montevideo/", "country=uy", "region=uruguay"],
    "AR": ["/argentina/", "/ar/", "/buenosaires/", "country=ar", "region=argentina"],
    "BR": ["/brasil/", "/brazil/", "/br/", "/saopaulo/", "country=br", "region=brasil"],
    "CL": ["/chile/", "/cl/", "/santiago/", "country=cl", "region=chile"],
    "CO": ["/colombia/", "/co/", "/bogota/", "country=co", "region=colombia"],
    "PE": ["/peru/", "/pe/", "/lima/", "country=pe", "region=peru"],
    "EC": ["/ecuador/", "/ec/", "/quito/", "country=ec", "region=ecuador"],
    "MX": ["/mexico/", "/mx/", "/mexicocity/", "country=mx", "region=mexico"],
    "US": ["/usa/", "/us/", "/america/", "country=us", "region=usa"],
    "ES": ["/espana/", "/spain/", "/es/", "/madrid/", "country=es", "region=spain"],
}
COUNTRY_QUERY_TERMS = {
    "UY": ["uruguay", "uy", "montevideo", "maldonado", "punta del este", "canelones"],
    "AR": ["argentina", "ar", "buenos aires", "bsas", "cordoba", "rosario"],
    "BR": ["brasil", "brazil", "br", "sao paulo", "rio", "brasil.com"],
    "CL": ["chile", "cl", "santiago", "valparaiso", "concepcion"],
    "CO": ["colombia", "co", "bogota", "medellin", "cali"],
    "PE": ["peru", "pe", "lima", "arequipa", "trujillo"],
    "EC": ["ecuador", "ec", "quito", "guayaquil", "cuenca"],
    "MX": ["mexico", "mx", "ciudad mexico", "guadalajara", "monterrey"],
    "US": ["usa", "us", "america", "new york", "los angeles"],
    "ES": ["espana", "spain", "es", "madrid", "barcelona"],
}
FOREIGN_TLDS = [".mx", ".pe", ".ar", ".br", ".cl", ".co", ".cr", ".es", ".pt"]
HOME_TLDS = [".com.uy", ".gub.uy", ".org.uy", ".edu.uy", ".net.uy", ".uy"]
ENHANCE_TEMPLATES = ["%s Uruguay", "comprar %s Uruguay", "%s Montevideo", "%s tienda Uruguay"]

# ---- fixed values: relevance ---------------------------------------------------------------
RELEVANCE_STOP_WORDS = [
    "de", "la", "el", "los", "las", "y", "o", "para", "por", "con", "sin",
    "en", "un", "una", "unos", "unas", "del", "al", "a", "the", "and", "or",
    "for", "with", "on", "of", "to",
]
LOCATION_WORDS = ["montevideo", "mvd", "mvdeo", "envio a montevideo", "retiro en montevideo"]

# ---- fixed values: prices ------------------------------------------------------------------
_GROUPED = r"(\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{1,2})?)"
_PLAIN = r"(\d+(?:[.,]\d{3})*(?:[.,]\d{1,2})?)"
_GROUPED_DOT = r"(\d{1,3}(?:\.\d{3})*(?:,\d{1,2})?)"
_PLAIN_DOT = r"(\d+(?:\.\d{3})*(?:,\d{1,2})?)"
# (pattern with one group, currency, floor, confidence, label); order is priority
DIRECT_PRICE_COMPAT = [
    (r"(?i)U\$S\s*" + _GROUPED, "USD", 10.0, 0.95, "U$S "),
    (r"(?i)US\$\s*" + _GROUPED, "USD", 10.0, 0.95, "U$S "),
    (r"(?i)USD\s*" + _GROUPED, "USD", 10.0, 0.95, "U$S "),
    (r"(?<![US])\$\s*" + _GROUPED_DOT, "UYU", 100.0, 0.90, "$ "),
    (r"UYU\s*" + _GROUPED, "UYU", 100.0, 0.90, "$ "),
]
DIRECT_PRICE_PLAIN = [
    (r"(?i)U\$S\s*" + _PLAIN, "USD", 10.0, 0.95, "U$S "),
    (r"(?i)US\$\s*" + _PLAIN, "USD", 10.0, 0.95, "U$S "),
    (r"(?i)USD\s*" + _PLAIN, "USD", 10.0, 0.95, "U$S "),
    (r"(?<![US])\$\s*" + _PLAIN_DOT, "UYU", 100.0, 0.90, "$ "),
    (r"UYU\s*" + _PLAIN, "UYU", 100.0, 0.90, "$ "),
]
USD_MARKERS = ["U$S", "US$", "USD", "U$$", "DOLARES", "DÓLARES", "DOLLARS"]
UYU_MARKERS = ["UYU", "UY$", "PESOS"]
CURRENCY_ALIASES = {
    "UYU": "UYU", "USD": "USD", "EUR": "EUR", "GBP": "GBP",
    "$": "UYU", "UY$": "UYU", "U$U": "UYU", "PESOS": "UYU", "PESO": "UYU", "PESOS URUGUAYOS": "UYU",
    "U$S": "USD", "US$": "USD", "U$$": "USD", "DOLLARS": "USD", "DOLLAR": "USD", "DOLARES": "USD",
}
MAX_RESPONSE_PRICE = 1000000.0
NAME_STOP_WORDS = [
    "nuevo", "oferta", "original", "promo", "promocion", "promoción",
    "envio", "envío", "gratis", "pack", "combo",
]

# ---- fixed values: decision lifetimes in seconds -------------------------------------------
DECISION_TTL = {"search": 3600, "geo": 604800, "page_type": 21600, "relevance": 21600, "price": 7200}

# ---- fixed values: response recovery -------------------------------------------------------
RESPONSE_FIELDS = ["page_type", "identified_product_name", "category_name", "reasoning"]
RESPONSE_SKIP_KEYS = ["queries", "query", "search", "results", "page_type", "reasoning"]

# ---- fixed values: English stop words of the text vector -----------------------------------
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her "
    "hers herself it its itself they them their theirs themselves what which who whom this that these "
    "those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there when where "
    "why how all any both each few more most other some such no nor not only own same so than too very s "
    "t can will just don should now"
).split()

# ---- fixed values: log routes and drop rules -----------------------------------------------
LOG_ROUTES = [
    ("applications", r"/var/log/containers/[^/]*_default_[^/]*\.log"),
    ("observability", r"/var/log/containers/[^/]*_observability_[^/]*\.log"),
    ("infrastructure", r"/var/log/containers/[^/]*_shared_[^/]*\.log"),
    ("traffic", r"/var/log/containers/[^/]*traefik[^/]*_kube-system_[^/]*\.log"),
    ("dns", r"/var/log/containers/[^/]*coredns[^/]*_kube-system_[^/]*\.log"),
]
LOG_DROP_RULES = [
    ("observability", r"Per stream rate limit exceeded", "rate_limit_feedback_loop"),
    ("observability", r"code = Code\(429\)", "rate_limit_429_errors"),
]
