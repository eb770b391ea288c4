"""Stopword sets, noise terms, rule patterns, labels and actions.

Everything in this file must equal the published values for results to match. Brand names
are not part of the sets: callers pass their own through ``brand_terms``.
"""

from __future__ import annotations

SENTIMENT_STOPWORDS = frozenset(
    """
    a acerca agora ainda alem algo algum alguma algumas alguns ali ambos ante antes ao aos apos
    aquela aquelas aquele aqueles aquilo as ate cada com como contra da das de dela delas dele
    deles depois desde desta deste disso disto do dos e ela elas ele eles em entre era eram essa
    essas esse esses esta estamos estao estas estava estavam este estes eu foi foram ha isso isto
    ja lhe lhes mas me mesmo meu minha na nas no nos nossa nossas nosso nossos o os ou para pela
    pelas pelo pelos por quais qual quando que quem se seja sendo ser seria seu seus sua suas tal
    tambem te tem tendo tenho ter teu teus tu um uma umas uns vai vao voce voces vou
    """.split()
)

PIPELINE_STOPWORDS = frozenset(
    """
    a ao aos as com como da das de do dos e em essa esse esta este eu foi ha isso ja mas me meu
    minha na nas no nos o os ou para por que se sem sua um uma veja
    """.split()
)

TOPIC_NEUTRAL_STOPWORDS = frozenset(
    """
    aplicativo app cliente clientes gente pessoa pessoas pq pra pro pros q ta tava tb tbm to vc
    vcs voce voces
    """.split()
)

NEGATORS = frozenset("jamais nada nao nem nenhum nenhuma nunca sem".split())

TOPIC_STOPWORDS = SENTIMENT_STOPWORDS | TOPIC_NEUTRAL_STOPWORDS | NEGATORS

TOPIC_CLUSTER_STOPWORDS = TOPIC_STOPWORDS | frozenset(
    """
    adorei adoro amo banco bancos bastante bem boa boas bom bons dinheiro estavel excelente
    excelentes fantastico gostei gosto horriveis horrivel incrivel legal mais mal maravilhosa
    maravilhoso mega melhor melhores menos muito otima otimas otimo otimos perfeita perfeito pior
    piores pouco rapida rapido recomendo ruim ruins sensacional show so super terriveis terrivel
    top
    """.split()
)

STOPWORD_PROFILES = {
    "sentiment": SENTIMENT_STOPWORDS,
    "pipeline": PIPELINE_STOPWORDS,
    "topic_neutral": TOPIC_NEUTRAL_STOPWORDS,
    "topic": TOPIC_STOPWORDS,
    "topic_cluster": TOPIC_CLUSTER_STOPWORDS,
}

POSITIVE_NOISE = (
    "otimo",
    "excelente",
    "bom",
    "amei",
    "perfeito",
    "maravilhoso",
    "gostei",
    "muito boa",
    "muito bom",
    "top",
)
NEGATIVE_NOISE = (
    "horrivel",
    "pessimo",
    "ruim",
    "demorado",
    "problema",
    "travando",
    "erro",
    "lixo",
    "nao abre",
    "nao funciona",
)

# Business themes, first match wins.
THEME_RULES = (
    ("Conta bloqueada e acesso", r"bloquead|desbloq|acesso|login|senha|biometr|cadastro|recuperar"),
    ("Empréstimo e crédito", r"emprest|credito|consign|limite|parcel|financi"),
    ("Cartão e fatura", r"cartao|fatura|chip|virtual|compra|maquin|anuidade"),
    ("Pix e transferências", r"\bpix\b|transfer|ted|doc|transferencia|enviad"),
    ("Cobrança e contestação", r"cobranc|juros|taxa|estorno|reembolso|iof|duplic"),
    ("Atendimento e suporte", r"atendimento|suporte|chat|sac|protocol|resposta|demora"),
    ("Privacidade e segurança", r"fraude|seguran|privacidade|dados|clon|golpe|verificacao"),
    ("Conta e cadastro", r"\bconta\b|abrir conta|documento|registro|perfil"),
    ("App e estabilidade", r"\bapp\b|aplicativ|trav|erro|bug|instal|lent"),
)

DEFAULT_ACTION = "Investigar a causa raiz e confirmar com amostras textuais."
# Theme name -> action, ordered substring rules.
THEME_ACTIONS = (
    (("bloqueada", "acesso", "login"), "Reduzir friccao de acesso e revisar desbloqueio."),
    (("emprest", "credito"), "Ajustar jornada de oferta, limite e comunicacao do credito."),
    (("cartao", "fatura"), "Melhorar gestao de cartao, fatura e suporte a uso recorrente."),
    (("pix", "transfer"), "Reforcar status de transacoes e confiabilidade das transferencias."),
    (("cobranca", "contestacao"), "Acelerar contestacao, estorno e explicacao de cobranças."),
    (
        ("atendimento", "suporte"),
        "Diminuir tempo de resposta e reforcar resolucao no primeiro contato.",
    ),
    (
        ("privacidade", "seguranca"),
        "Refinar validacao de identidade e comunicacao de seguranca.",
    ),
    (("app",), "Priorizar estabilidade, velocidade e reducao de erros no aplicativo."),
)

# Topic keywords -> label, ordered substring rules.
TOPIC_LABELS = (
    (("bloque", "acesso", "login", "senha", "cadastro", "recuper"), "Conta bloqueada / acesso"),
    (("emprest", "credito", "limite", "parcel", "financi"), "Empréstimo / crédito"),
    (("pix", "transfer", "ted", "doc"), "Pix / transferências"),
    (("cobranc", "juros", "taxa", "estorno", "reembolso", "contest"), "Cobrança / contestação"),
    (("atendimento", "suporte", "chat", "sac", "protoc"), "Atendimento / suporte"),
    (("fraud", "seguran", "privacidad", "golpe", "clon"), "Segurança / fraude"),
    (("app", "erro", "trav", "instal", "lent"), "App / estabilidade"),
)
CARD_MARKERS = ("fatura", "chip", "virtual", "compra", "anuidade")
CARD_BILL_LABEL, CARD_USE_LABEL, CARD_SUPPORT_LABEL = (
    "Cartão / fatura",
    "Cartão / uso",
    "Cartão / suporte",
)
ACCOUNT_MARKERS = ("saldo", "extrato", "mov", "pix", "valor")
ACCOUNT_LABEL = "Conta / movimentação"
CREDIT_OFFER_LABEL, CREDIT_LOAN_LABEL, CREDIT_ELIGIBILITY_LABEL = (
    "Crédito / oferta",
    "Empréstimo / crédito",
    "Crédito / elegibilidade",
)
ACCESS_LABEL = "Conta bloqueada / acesso"
ACCESS_MARKERS = ("bloque", "acess", "login", "senha", "consig", "entrar")
NO_TOPIC_LABEL = "Tema sem rotulo"

MIXED_ACTION = "Revisar jornada e validar com amostras antes de escalar correcao."
# Topic name -> action, ordered substring rules.
CLUSTER_ACTIONS = (
    (
        ("bloque", "acesso", "login", "senha"),
        "Reduzir friccao de acesso e simplificar desbloqueio.",
    ),
    (
        ("emprest", "credito", "limite"),
        "Ajustar comunicacao de credito, limite e elegibilidade.",
    ),
    (("cartao", "fatura"), "Melhorar suporte de cartao, fatura e recorrencia de uso."),
    (("pix", "transfer"), "Reforcar status de transacoes e confiabilidade das transferencias."),
    (
        ("cobranc", "contest", "estorno"),
        "Acelerar contestacao, estorno e explicacao de cobrancas.",
    ),
    (
        ("atendimento", "suporte", "chat"),
        "Diminuir tempo de resposta e reforcar resolucao no primeiro contato.",
    ),
    (
        ("seguran", "fraud", "privacidad"),
        "Refinar validacao de identidade e comunicacao de seguranca.",
    ),
    (
        ("app", "estabil", "erro", "trav"),
        "Priorizar estabilidade, velocidade e reducao de erros no app.",
    ),
)

SOURCE_DISPLAY = {
    "google_play": "Google Play",
    "youtube": "YouTube",
    "consumidor_gov": "Consumidor.gov",
}

NULL_LIKE = ("", "nan", "none", "sem informacao", "nao informado")

# Thresholds.
UNCERTAIN_CONFIDENCE, UNCERTAIN_MARGIN = 0.55, 0.15
SIGNAL_SHARE, SIGNAL_MARGIN = 0.55, 0.15
NEUTRAL_GUARD = 0.05
NEUTRAL_WARNING = 0.4
PREVIEW_CHARS = 220
