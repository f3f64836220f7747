"""A labelled sample of template residue and of descriptions that merely read alike.

Written from general knowledge of templates, browsers and office software as slot grammars:
each template with every choice of its slots, ``(label, template, text)``.  Labels are
'placeholder', 'filler', 'notice' and 'natural'; texts are lower case with digits as 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from http import HTTPStatus
from itertools import islice, product

#: Bound on the texts that one template contributes, those of smallest hash.
PER_TEMPLATE = 60
#: Names that templates refer to besides the fields of the data.
NAMES = "item product name title value field description price amount date unit brand model size n x articulo nombre titulo valor campo descripcion precio cantidad fecha unidad medida marca modelo material".split()
_OPEN_CLOSE = "{ } {{ }} {{{ }}} ${ } #{ } %( )s % % < > << >> [[ ]] @@ @@ @ @ # # & ; __ __ <%= %> <?= ?> {% %} <!-- --> $ $ [% %] {{- -}}".split()

#: Labelled templates: slots are choices between bars in angle brackets, § is a name or
#: another text, ¶ is any notice.
PLACEHOLDERS = (
    "[⟨insertar|indicar|completar|añadir|especificar|introducir|insert|enter|specify|add|inserir|indiqueu|definir⟩ §]", "[§ ⟨a definir|por definir|pendiente|según proyecto|tbd|to be defined|a completar⟩]", "(⟨rellenar|completar|indicar|especificar|fill in|a completar⟩ § ⟨según proyecto|si procede|aquí|here⟩)", "⟨<|[|(|<<|{⟩⟨completar|indicar §|a completar|por completar|rellenar|insertar §|pendiente|fill in⟩⟨>|]|)|>>|}⟩", "[⟨pendiente|todo|falta|missing⟩: §]",
    "⟨???|?????|____|______|_________|xxx|xxxx|xxxxx|######|--/--⟩⟨| m| mm| cm| kg| kv| %⟩", "⟨undefined|null|nan|none|nil|(null)|<null>|[object object]|nonetype⟩⟨| m| mm| cm| kg| kv| m0|,|;⟩", "⟨#n/a|#n/d|#ref!|#¡ref!|#value!|#¡valor!|#div/0!|#¡div/0!|#name?|#¿nombre?|#num!|#null!⟩⟨| mm| m|,⟩", "⟨%s|%d|%f|%0.0f|{0}|{0:}|{0:.0f}|{}|$0|${0}⟩⟨| mm| m| cm|,|;⟩", "⟨tbd|tba|t.b.d.|n/a|s/d|p.d.⟩⟨|.|,| mm⟩",
    "⟨$|%⟩⟨a|b|c|d|f|g|h|i|j|k⟩⟨ |,|;|.| mm| cm| m⟩", "$⟨t|s|r|u⟩(%⟨a|b|c|d|f⟩)", "$⟨t|s|r|u⟩(%⟨a|b|c|d⟩,%⟨a|b|c|d|f⟩)",
)
FILLER = (
    "⟨texto|contenido|descripción|título|resumen|párrafo⟩ ⟨de ejemplo|de prueba|de relleno|de muestra|provisional|temporal|por defecto|simulado⟩⟨|.|,⟩", "⟨texto|contenido|descripción|título|apartado⟩ ⟨pendiente|pendiente de redactar|sin redactar|pendiente de completar|por redactar|a completar⟩⟨|.⟩", "⟨sustituir|reemplazar|cambiar|borrar⟩ ⟨por el texto definitivo|por la descripción real|antes de publicar|por el contenido final|por la descripción correcta⟩⟨|.⟩", "⟨no publicar|no usar|borrador|borrador sin revisar⟩⟨|.⟩",
    "⟨escriba|introduzca|inserte|ponga|añada|redacte⟩ aquí ⟨el texto|la descripción|el contenido|su texto|el nombre⟩⟨| de la partida| del artículo| del producto| de la unidad| del concepto⟩", "⟨nuevo|nueva⟩ ⟨concepto|artículo|partida|documento|elemento|capítulo⟩ ⟨(copia)|(0)|sin título|(copia 0)|0⟩", "copia de ⟨nuevo concepto|partida|documento0|artículo⟩", "⟨todo|fixme|pendiente⟩: ⟨revisar|completar|añadir|poner⟩ ⟨la descripción|el texto|este texto|la partida|esta partida⟩", "⟨todo|fixme|pendiente⟩: ⟨descripción|texto|resumen⟩ ⟨del artículo|del producto|de la unidad|del concepto⟩",
    "⟨text|contingut|descripció⟩ de ⟨mostra|prova|exemple⟩⟨|,| pendent| per substituir⟩⟨| d'omplir| de redactar⟩", "⟨escriviu|introduïu⟩ aquí ⟨el text|la descripció|el contingut⟩", "⟨texto|conteúdo|descrição⟩ de ⟨exemplo|teste|amostra⟩⟨|, substituir⟩", "⟨escreva|insira⟩ aqui ⟨o texto|a descrição|o conteúdo⟩",
    "⟨insert|enter|add|type|write|put⟩ ⟨description|text|title|your text|content|name⟩ here", "⟨sample|dummy|placeholder|example|default|filler⟩ ⟨text|content|description|paragraph⟩", "⟨your text|text|content|description⟩ ⟨goes here|to follow|coming soon|to be added⟩", "⟨description|text|item⟩ to be ⟨completed|defined|written⟩", "new ⟨item|document|record⟩ ⟨(copy)|(0)|untitled⟩",
    "⟨asdf|asdf asdf|asdfgh|asdfasdf|qwerty|qwertyuiop|qwerty qwerty|zxcvbn|jklñ jklñ|blablabla|bla bla bla|aaaa aaaa|foo bar baz|abc abc abc⟩⟨| asdf| 000|.⟩", "⟨prueba|test|prova|teste⟩ ⟨prueba|test|prova|teste|0|0 0 0⟩⟨| prueba| test| 0|.⟩", "lorem ipsum⟨| dolor| dolor sit amet|.|,⟩",
)
LOREM = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum".split()
NOTICES = (
    "⟨página|recurso|archivo|documento|ficha|servidor|artículo|contenido⟩ no ⟨encontrado|encontrada|disponible|localizado⟩", "no se ⟨encuentra|ha encontrado|puede mostrar|ha podido cargar|pudo abrir|ha podido procesar⟩ ⟨la página|el documento|el contenido|la ficha|su solicitud|el recurso⟩⟨| solicitada| solicitado⟩", "⟨la página|el recurso|el documento|la ficha|el contenido⟩ ⟨solicitada no existe|ya no existe|no existe|no está disponible|ha sido eliminado|se ha movido⟩",
    "⟨se ha producido|ha ocurrido|se produjo|hubo⟩ un error⟨| inesperado| interno| de conexión⟩⟨| al cargar la página| al procesar su solicitud| al abrir la ficha| al consultar los datos⟩", "⟨fallo|error⟩ ⟨interno del servidor|de conexión con el servidor|de base de datos|desconocido|del servidor|de red⟩", "acceso ⟨denegado|prohibido|no autorizado|no permitido⟩", "no ⟨tiene|dispone de⟩ ⟨permiso|permisos|autorización⟩ para ⟨ver|acceder a|consultar⟩ ⟨este recurso|esta página|este contenido|esta sección⟩",
    "⟨la|su⟩ sesión ha ⟨caducado|expirado|finalizado⟩", "sesión ⟨caducada|expirada|no válida⟩", "⟨debe|es necesario⟩ ⟨iniciar sesión|identificarse|registrarse|autenticarse⟩⟨| para continuar⟩", "inicie sesión ⟨de nuevo|para continuar|otra vez⟩", "tiempo de ⟨espera|respuesta⟩ ⟨agotado|excedido|superado⟩⟨| al conectar| al consultar los datos⟩", "el servidor ⟨no responde|ha tardado demasiado|está saturado|no está disponible|ha rechazado la conexión|tardó demasiado en contestar⟩",
    "⟨inténtelo|pruebe|intente acceder|vuelva a intentarlo|vuelva a probar⟩ ⟨de nuevo|más tarde|en unos minutos|pasados unos minutos⟩", "⟨vuelva a intentarlo|inténtelo otra vez|pruebe otra vez|recargue la página|actualice la página⟩", "servicio ⟨no disponible|temporalmente no disponible|en mantenimiento|suspendido⟩", "⟨solicitud|petición|puerta de enlace|pasarela⟩ ⟨incorrecta|no válida|errónea⟩", "⟨póngase en contacto|contacte⟩ con ⟨el administrador|el soporte técnico|el servicio técnico⟩", "demasiadas ⟨solicitudes|peticiones⟩",
    "pàgina no ⟨trobada|disponible⟩", "accés ⟨denegat|prohibit⟩", "error ⟨intern del servidor|de connexió|del servidor⟩", "servei no disponible", "⟨torneu-ho a provar|proveu-ho de nou⟩ més tard", "la sessió ha ⟨caducat|expirat⟩", "heu d'iniciar la sessió", "no s'ha ⟨pogut carregar|trobat⟩ ⟨la pàgina|el document|la fitxa⟩",
    "página não ⟨encontrada|disponível⟩", "acesso ⟨negado|proibido⟩", "erro ⟨interno do servidor|de conexão|ao carregar a página⟩", "serviço ⟨indisponível|não disponível⟩", "tente ⟨novamente|de novo⟩ mais tarde", "a sessão ⟨expirou|terminou⟩",
    "an ⟨unexpected error|error|internal error⟩ ⟨occurred|has occurred⟩⟨| while loading the page| while processing your request| while fetching the item⟩", "⟨please |⟩try again⟨| later| in a few minutes⟩", "you do not have permission to ⟨view|access⟩ this ⟨page|resource|document⟩", "your session has ⟨expired|timed out⟩", "please ⟨log|sign⟩ in ⟨again|to continue⟩", "the ⟨page|item|file|resource|requested item⟩ ⟨could not be found|could not be loaded|could not be located|cannot be displayed|no longer exists⟩", "⟨access|permission⟩ ⟨denied|refused⟩", "⟨page|file|item⟩ not ⟨found|available⟩", "connection ⟨refused|timed out|reset⟩", "⟨server|database⟩ error",
    "⟨exception|error|fatal error|warning⟩: ⟨timeout|null reference|connection lost|tiempo de espera agotado|división por cero|no se pudo conectar|undefined index|undefined variable⟩⟨| al consultar los datos| in line 0⟩", "⟨null pointer exception|nullpointerexception|traceback (most recent call last)|stack trace|segmentation fault|unhandled exception⟩", "⟨se requiere|⟩ ⟨autenticación requerida|inicio de sesión obligatorio⟩",
)
SCRIPTS = (
    "⟨active|habilite|permita|debe activar|debe habilitar|necesita activar|necesita habilitar|es necesario activar|es necesario habilitar|por favor active⟩ ⟨javascript|los scripts|las cookies|javascript y las cookies|la ejecución de scripts⟩⟨| en su navegador| en el navegador⟩⟨| para ver este contenido| para ver esta página| para continuar| y recargue la página⟩", "⟨su|este|el⟩ navegador no ⟨admite|soporta|permite⟩ ⟨javascript|scripts|los scripts⟩⟨| o están desactivados| o los tiene bloqueados⟩", "javascript ⟨está desactivado|no está habilitado|está deshabilitado|es necesario⟩⟨| en su navegador⟩", "esta ⟨página|ficha|web⟩ ⟨requiere|necesita|precisa⟩ ⟨javascript|scripts⟩⟨| para funcionar⟩",
    "cal ⟨activar|habilitar⟩ ⟨javascript|els scripts⟩⟨| per veure la pàgina| per continuar⟩", "el vostre navegador no ⟨admet|permet⟩ ⟨scripts|javascript⟩", "⟨ative|habilite⟩ o javascript⟨| no seu navegador| para continuar⟩", "o seu navegador não suporta ⟨scripts|javascript⟩",
    "⟨please |⟩⟨enable|turn on|activate⟩ ⟨javascript|scripts|cookies|javascript and cookies⟩⟨| in your browser⟩⟨| to continue| to view this page| and reload⟩", "you need to enable ⟨javascript|scripts⟩⟨| to run this app| to continue⟩", "your browser does not support ⟨javascript|scripts⟩", "javascript is ⟨disabled|required|not enabled|turned off⟩", "this ⟨page|site|app⟩ requires ⟨javascript|scripts|cookies⟩", "turn them on and ⟨reload|try again⟩",
)
#: How notices are shown.
WRAPPED = ("§", "§.", "§,", "error 000: §", "000 §", "000: §", "error 000 §", "http 000 §", "http/0.0 000 §", "§ (000)", "§ (código 000)", "§. código 000.", "<title>§</title>", "<h0>000</h0> <p>§</p>", "<p>§</p>", "<b>§</b>", "¡ups! §.", "¡vaya! §.", "oops! §", "lo sentimos: §.", "aviso: §", "§!", "§;", "[§]")
NATURAL = (
    "⟨alarma|señal|indicación|registro|contacto⟩ ⟨por|de|en caso de⟩ ⟨error 0|fallo|avería|pérdida de comunicación|¶⟩ ⟨cableada a|conectada a|enviada a|transmitida a|con salida a⟩ ⟨central|cuadro|la sala de control|puesto de mando|armario⟩", "⟨aviso|zumbador|piloto|parada⟩⟨| sonoro| óptico| automática⟩ ⟨tras|por|ante⟩ ⟨error|error 0|error 000|fallo 00|código 00⟩ del ⟨variador|convertidor|autómata|sensor|contador⟩", "error ⟨de cierre|de medida|de lectura|de fase|máximo|angular|de nivelación⟩ ⟨inferior a|menor de|de hasta|no superior a⟩ 0 ⟨mm|%|cm|grados⟩", "⟨script|programa|guion⟩ de ⟨arranque|control|regulación|mando⟩ ⟨del autómata|del plc|de la bomba|del variador⟩⟨| instalado| incluido⟩", "con ⟨navegador|menú|pantalla|visor⟩ de ⟨menús|consulta|alarmas|estado⟩ ⟨en el panel|en la puerta|integrado⟩",
    "con ⟨plantilla|modelo|patrón⟩ de ⟨corte|montaje|taladro|pintura⟩", "⟨relleno|material|muestra|árido⟩ ⟨de ejemplo|de muestra|de relleno|de prueba⟩ ⟨aceptado|aprobada por la dirección|ensayado|compactado|de la cantera⟩", "⟨según |⟩⟨página|hoja|plano|lámina⟩ ⟨0|00|000⟩ del ⟨proyecto|pliego|anexo|documento⟩", "⟨bornes|contactos|terminales|hilos⟩ {⟨a|b|l|x⟩0, ⟨a|b|l|x⟩0}", "⟨chapa|pieza|módulo|tapa|plancha⟩ [⟨a|b|c|m⟩-0]", "⟨nivel|ruido|potencia|absorción|temperatura|humedad⟩ ⟨<|>|±⟩⟨0|00⟩ ⟨db|%|w|mm⟩", "⟨pendiente|caída|inclinación|peralte|dosificación|mezcla⟩⟨| del⟩ ⟨0|00⟩ %⟨| m| b| a| de finos⟩", "⟨coste|precio|importe|canon|tasa⟩ ⟨estimado|aproximado|orientativo|de⟩ ⟨0|00|000⟩ ⟨$|€|£⟩ por ⟨metro|unidad|hora|m0⟩", "talla ⟨xl|xxl|xxxl⟩ en ⟨guantes|chalecos|vestuario|botas⟩", "prueba de ⟨presión|carga|estanqueidad|funcionamiento|servicio⟩⟨| a 0 bar| incluida| final⟩", "⟨tolerancia|precisión|desviación⟩ de ±0 ⟨mm|cm|%⟩", "⟨acceso|paso|entrada⟩ ⟨restringido|reservado|controlado|peatonal⟩ ⟨a obra|al personal|por tarjeta|con torno⟩", "servicio ⟨de guardia|de grúa|nocturno|de vigilancia⟩⟨| disponible| incluido| no incluido⟩", "sistema de ⟨registro|sesiones|aviso|control de acceso⟩ ⟨por tarjeta|con servidor local|con base de datos|en red⟩", "con ⟨servidor|página web|pantalla⟩ ⟨de datos|de consulta|táctil|integrada⟩ ⟨en el armario|en el cuadro|y cableado⟩", "contenido ⟨de humedad|de arcilla|de finos|de cemento⟩ ⟨inferior al|máximo del⟩ 0 %", "descripción ⟨del trazado|en planos|según pliego⟩", "documento de ⟨idoneidad|entrega|garantía⟩", "gama ⟨alta|media|básica⟩⟨|, oferta⟩", "filtro de 0 µm", "unidad ⟨nueva|completa|terminada⟩, copia de llaves", "nueva partida de ⟨tubos|ladrillos|material⟩",
    "⟨texto|letras|leyenda|rotulación⟩ ⟨en relieve|grabada|adhesiva|en vinilo⟩",
)
# End of the labelled templates.

_SLOT = re.compile("⟨([^⟩]*)⟩")


def _texts(template: str) -> Iterator[str]:
    parts = _SLOT.split(template)
    for choice in product(*(p.split("|") for p in parts[1::2])):
        yield "".join(a + b for a, b in zip(parts[::2], [*choice, ""])).strip()


def chosen(texts: Iterator[str], most: int = PER_TEMPLATE) -> list[str]:
    """Those of smallest hash, the same in every process."""
    return sorted(set(islice(texts, 20_000)), key=lambda x: blake2b(x.encode(), digest_size=8).digest())[:most]


def specimens(names: list[str]) -> list[tuple[str, str, str]]:
    """``(label, template, text)``; placeholders also mention the given field names."""
    plain = sorted({n.lower() for n in names})
    snake = sorted({re.sub(r"\W+", "_", n) for n in plain} | {re.sub(r"\W+", "_", n.translate(str.maketrans("áéíóúüñç", "aeiouunc"))) for n in plain} | set(NAMES))
    found = []
    for a, b in zip(_OPEN_CLOSE[::2], _OPEN_CLOSE[1::2]):
        inner = [x for n in snake for x in (n, f" {n} ", f"item.{n}", f" item.{n} ")][: 4 * len(snake)]
        found += [("placeholder", f"{a}§{b}", f"{a}{x}{b}") for x in chosen(iter(inner))]
    for template in PLACEHOLDERS:
        texts = chosen(x.replace("§", n) for x in _texts(template) for n in ([*plain, *snake] if "§" in x else [""]))
        found += [("placeholder", template, x) for x in texts]
    for template in FILLER:
        found += [("filler", template, x) for x in chosen(_texts(template))]
    found += [("filler", f"lorem {k % 10}", " ".join(LOREM[k : k + 4 + k % 5])) for k in range(len(LOREM) - 4)]
    status = [s.phrase.lower() for s in HTTPStatus if s >= 400]
    for k, base in enumerate((*NOTICES, *SCRIPTS, *status)):
        texts = chosen(_texts(base), 24)
        found += [("notice", base, WRAPPED[(k + j * 7) % len(WRAPPED)].replace("§", x) if j % 3 else x) for j, x in enumerate([*texts, *texts])]
    said = [x for base in NOTICES for x in chosen(_texts(base), 32) if x.startswith(("servidor", "acceso", "sesión", "tiempo", "error", "fallo", "servicio")) and len(x.split()) < 4]
    for template in NATURAL:
        texts = chosen(_texts(template))
        # what an alarm reports may be any short notice
        found += [("natural", template, texts[j % len(texts)].replace("¶", x)) for j, x in enumerate(said)] if "¶" in template else [("natural", template, x) for x in texts]
    return found
