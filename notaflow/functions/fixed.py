"""Values that the business fixes: names, patterns and limits, in the order in which they apply."""

# Fixed values.
TOLERANCE = 0.01
MIN_WORKING_DAYS = 4
SEVERITY = {"CRITICA": 3.0, "ALTA": 2.0, "MEDIA": 1.0, "BAIXA": 0.5, "INFO": 0.1}
SLOW_WARNING_S, SLOW_S = 5.0, 20.0
HISTOGRAM_BOUNDS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
CHUNK_WORDS, CHUNK_OVERLAP = 500, 50
HTML_MARK = "--- HTML CONTENT ---"

# Subjects that are never billing mail.
SUBJECT_BLACK = (
    r"\b(feliz\s+)?(natal|ano\s*novo|páscoa|festas)\b",
    r"\bcomunicado\b",
    r"\b(horário|funcionamento|expediente)\b",
    r"\bnews(letter)?\b",
    r"\bnotícias\b",
    r"\bconfira\b",
    r"^(re|res|fw|fwd|enc):\s*(re|res|fw|fwd|enc):",
    r"\b(promoção|oferta|desconto)\b",
    r"\binscreva-?se\b",
    r"\bimpactar\s+seu\s+negócio\b",
    r"\bnotificação\s+de\s+regularização\b",
    r"\baviso\s+de\s+vencimento\b",
    r"\blembrete\s+aci\b",
    r"\bpré[\s-]?cobrança\b",
    r"\bajuste\s+(de\s+)?nf\b",
    r"\bdistrato\b",
)
# Subjects of billing mail.
SUBJECT_WHITE = (
    r"\bnota\s*fiscal\b",
    r"\bnf[\s-]?e\b",
    r"\bnf[\s-]?s[\s-]?e\b",
    r"\bnfcom\b",
    r"\bdanfe\b",
    r"\bfatura\b",
    r"\bboleto\b",
    r"\bcobrança\b",
    r"\bpagamento\b",
    r"\bvencimento\b",
    r"\bdébito\b",
    r"\bdívida\b",
    r"\brenovação\b",
    r"\bcontrato\b",
    r"\bmensalidade\b",
    r"\bassinatura\b",
    r"\baluguel\b",
    r"\b(energia|luz|cemig|edp|conta\s+de\s+luz)\b",
    r"\b(telecom|internet|fibra)\b",
    r"\benvio\s+de\b",
    r"\bsua\s+(fatura|conta|nf)\b",
    r"\bfaturamento\b",
    r"\bdocumento\b",
)
# Senders that are never billing mail.
SENDER_BLACK = (
    r"@(mail\.)?mailchimp\.com$",
    r"@(mail\.)?sendgrid\.(net|com)$",
    r"@(email\.)?hubspot\.com$",
    r"@(mail\.)?rdstation\.com\.br$",
    r"@(e\.)?mailjet\.com$",
    r"noreply@.*\.marketing\.",
    r"newsletter@",
    r"marketing@",
    r"promocoes@",
    r"ofertas@",
    r"@.*\.slack\.com$",
    r"@.*\.atlassian\.(com|net)$",
    r"@github\.com$",
    r"@linkedin\.com$",
    r"@facebookmail\.com$",
    r"@.*zendesk\.com$",
    r"@freshdesk\.com$",
)
# Senders of billing mail.
SENDER_WHITE = (
    r"@.*nfe\.fazenda\.gov\.br$",
    r"@.*\.gov\.br$",
    r"@.*sefaz.*\.gov\.br$",
    r"@.*prefeitura.*\.gov\.br$",
    r"@.*omie\.com\.br$",
    r"@.*bling\.com\.br$",
    r"@.*tiny\.com\.br$",
    r"@.*contaazul\.com$",
    r"@.*enotas\.com\.br$",
    r"@.*nfe\.io$",
    r"@.*plugnotas\.com\.br$",
    r"@.*tecnospeed\.com\.br$",
    r"@.*totvs\.com\.br$",
    r"@.*sankhya\.com\.br$",
    r"@.*senior\.com\.br$",
    r"@.*cemig\.com\.br$",
    r"@.*cpfl\.com\.br$",
    r"@.*copel\.com$",
    r"@.*sabesp\.com\.br$",
    r"@.*vivo\.com\.br$",
    r"@.*claro\.com\.br$",
    r"@.*tim\.com\.br$",
    r"faturamento@",
    r"cobranca@",
    r"financeiro@",
    r"nfe@",
    r"nfse@",
    r"notafiscal@",
    r"boleto@",
)
VALID_ATTACHMENT = r"\.(pdf|xml|zip|rar|7z)$"
# Parts of links to invoices, after http:// or https://.
LINK_PARTS = (
    r"nf[es]?\.",
    r"nota[^\s]*fiscal",
    r"danfe",
    r"sefaz",
    r"prefeitura",
    r"\.gov\.br",
    r"pmf\.",
    r"issqn",
    r"iss[.\-]",
    r"nfse",
    r"ginfes",
    r"abrasf",
    r"webiss",
    r"tributosmunicipais",
    r"tributos\.",
    r"\.omie\.com",
    r"\.bling\.com",
    r"\.tiny\.com",
    r"\.conta\.azul",
    r"\.nibo\.com",
    r"\.enotas\.com",
    r"\.nfe\.io",
    r"\.focusnfe\.com",
    r"\.webmaniabr\.com",
    r"\.plugnotas\.com",
    r"\.tecnospeed\.com",
    r"\.senior\.com",
    r"\.totvs\.com",
    r"\.sankhya\.com",
    r"click\.[^\s]+/track",
    r"\.rdstation\.com",
    r"\.mailchimp\.com",
    r"sendgrid\.",
    r"/consulta[^\s]*nf",
    r"/download[^\s]*xml",
    r"/validar",
    r"/verificar",
    r"2via",
    r"fatura",
    r"conta[^\s]*digital",
    r"boleto",
)
# Verification codes.
CODE_PATTERNS = (
    r"\b\d{44}\b",
    r"(?:código|codigo|chave)[^\n]{0,30}[:=]\s*([A-Z0-9]{8,12})",
    r"verifica[çc][aã]o[^\n]{0,20}[:=]\s*[A-Z0-9\-]{6,}",
)
# Attachments that are no documents.
IGNORED_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".p7s", ".smime", ".ics", ".vcf")
IGNORED_NAMES = (r"^image\d{3}\.", r"^logo", r"^assinatura", r"^signature")
# File names that carry an invoice number, first match wins.
NUMBER_IN_FILE_NAME = (
    r"NF[_\s\-]*(\d{4}[\.\/\-]\d+)",
    r"NF[_\s\-]*(\d+)",
    r"nfse[_\-]*(\d+)",
    r"[Nn]ota[_\s\-]*[Ff]iscal[_\s\-]*(\d+)",
    r"BOLETO[_\s\-]*NF[_\s\-]*(\d{4}[\.\/\-]\d+)",
    r"BOLETO[_\s\-]*NF[_\s\-]*(\d+)",
)
# File names of auxiliary documents.
AUXILIARY = ("demonstrativo", "atestado", "recibo", "comprovante", "declaracao", "declaração", "termo", "contrato", "recs", "recebimento")
# Bank codes.
BANKS = {
    "001": "BANCO DO BRASIL S.A.",
    "033": "BANCO SANTANDER BRASIL S.A.",
    "077": "BANCO INTER S.A.",
    "104": "CAIXA ECONÔMICA FEDERAL",
    "208": "BANCO BTG PACTUAL S.A.",
    "212": "BANCO ORIGINAL S.A.",
    "224": "BANCO FIBRA S.A.",
    "237": "BANCO BRADESCO S.A.",
    "246": "BANCO ABC BRASIL S.A.",
    "260": "NU PAGAMENTOS S.A. (NUBANK)",
    "290": "PAGSEGURO INTERNET S.A.",
    "336": "BANCO C6 S.A.",
    "341": "ITAÚ UNIBANCO S.A.",
    "399": "HSBC BANK BRASIL S.A.",
    "422": "BANCO SAFRA S.A.",
    "623": "BANCO PANAMERICANO S.A.",
    "634": "BANCO TRIÂNGULO S.A.",
    "655": "BANCO VOTORANTIM S.A.",
    "748": "BANCO COOPERATIVO SICREDI S.A.",
    "756": "BANCO COOPERATIVO DO BRASIL S.A. (BANCOOB)",
}
# National holidays (month, day), and those of the city of São Paulo.
NATIONAL = ((1, 1), (4, 21), (5, 1), (9, 7), (10, 12), (11, 2), (11, 15), (12, 25))
CITY = ((1, 25), (11, 20))
#: Days from Easter: carnival (two), Good Friday, Easter itself, Corpus Christi.
FROM_EASTER = (-48, -47, -2, 0, 60)
# Payment codes.
PAYMENT = {
    "01": "DINHEIRO",
    "02": "CHEQUE",
    "03": "CARTÃO DE CRÉDITO",
    "04": "CARTÃO DE DÉBITO",
    "05": "CRÉDITO LOJA",
    "10": "VALE ALIMENTAÇÃO",
    "11": "VALE REFEIÇÃO",
    "12": "VALE PRESENTE",
    "13": "VALE COMBUSTÍVEL",
    "14": "DUPLICATA MERCANTIL",
    "15": "BOLETO",
    "16": "DEPÓSITO BANCÁRIO",
    "17": "PIX",
    "18": "TRANSFERÊNCIA BANCÁRIA",
    "19": "PROGRAMA DE FIDELIDADE",
    "90": "SEM PAGAMENTO",
    "99": "OUTROS",
}
# Subjects of administrative mail.
ADMIN_SUBJECTS = (
    r"\b(sua\s+)?ordem\b.*\bagendad[ao]\b",
    r"\bagendamento\s+de\s+serviço\b",
    r"\bdistrato\b",
    r"\brescis[ãa]o\s*(contratual)?\b",
    r"\bencerramento\s+(de\s+)?contrato\b",
    r"\bsolicitação\s+de\s+encerramento\b",
    r"\bcancelamento\s+(de\s+)?contrato\b",
    r"\brelat[oó]rio\s+de\s+faturamento\b",
    r"\bplanilha\s+de\s+(confer[eê]ncia|faturamento)\b",
    r"\bcomprovante\s+de\s+solicitação\b",
    r"\bnotificação\s+automática\b",
    r"\bguia\s*[\|\-]?\s*(processo|execu[çc][aã]o|fiscal|trabalhist|rr)\b",
    r"\bguias\s*-?\s*(csc|processo)\b",
    r"\bcontrato(_|\s+)(site|master|renova[çc][aã]o|aditivo)\b",
    r"\bc[aâ]mbio\s+(hbo|globosat|band|sbt|record|programadora)\b",
    r"\blembrete\s+gentil\b",
    r"\b(december|january|february|march|april|may|june|july|august|september|october|november)\s*-?\s*\d{4}\s+invoice\s+for\b",
    r"\b(processo|execu[çc][aã]o)\s+(fiscal|trabalhist[ao]|judicial)\b",
    r"\banuidade\s+(crea|oab|crm|cfm|coren)\b",
    r"\breembolso\s+de\s+tarifas\b",
    r"\btarifas\s+csc\b",
    r"\balvim\s+nogueira\b",
    r"\bcobran[çc]a\s+indevida\b",
)
# What an administrative subject is called, first word found wins.
ADMIN_NAMES = {
    "ordem": "Ordem de serviço/agendamento",
    "agendamento": "Ordem de serviço/agendamento",
    "distrato": "Documento de distrato",
    "rescis": "Documento de rescisão contratual",
    "encerramento": "Documento de encerramento de contrato",
    "cancelamento": "Documento de cancelamento",
    "relatório": "Relatório/planilha de conferência",
    "relatorio": "Relatório/planilha de conferência",
    "planilha": "Relatório/planilha de conferência",
    "comprovante": "Comprovante administrativo",
    "notificação": "Notificação automática",
    "guia": "Guia jurídica/fiscal",
    "contrato_": "Documento de contrato",
    "contrato ": "Documento de contrato",
    "câmbio": "Documento de programação/câmbio",
    "cambio": "Documento de programação/câmbio",
    "lembrete": "Lembrete administrativo",
    "invoice": "Invoice internacional",
    "processo": "Processo jurídico",
    "execução": "Execução fiscal/judicial",
    "execucao": "Execução fiscal/judicial",
    "anuidade": "Taxa/anuidade de órgão",
    "reembolso": "Reembolso interno",
    "tarifa": "Documento de tarifas internas",
    "alvim": "Documento de condomínio",
    "cobrança indevida": "Reclamação de cobrança",
    "cobranca indevida": "Reclamação de cobrança",
}
# How a line with an address begins, and what is in one.
ADDRESS_BEGINS = (
    r"RUA\s+",
    r"R\.\s+",
    r"AVENIDA\s+",
    r"AV\.?\s+",
    r"ALAMEDA\s+",
    r"AL\.?\s+",
    r"TRAVESSA\s+",
    r"TV\.?\s+",
    r"PRAÇA\s+",
    r"PÇA\.?\s+",
    r"PRACA\s+",
    r"RODOVIA\s+",
    r"ROD\.?\s+",
    r"ESTRADA\s+",
    r"EST\.?\s+",
    r"LARGO\s+",
)
ADDRESS_PARTS = (
    r"\bCEP\s*:?\s*\d",
    r"\b\d{5}-?\d{3}\b",
    r"\bNº?\s*\d+",
    r"\bN°?\s*\d+",
    r"\s+-\s+CENTRO\b",
    r"\s+-\s+BAIRRO\b",
    r"\([\w\s]+/[A-Z]{2}\)",
    r"/[A-Z]{2}\)$",
)
# How a text begins that is no supplier of goods.
NO_GOODS_SUPPLIER = (
    r"CHAVE\s*(DE)?\s*ACESSO",
    r"CNPJ",
    r"CPF",
    r"IE\s*:",
    r"INSCRI",
    r"DOCUMENTO\s+AUXILIAR",
    r"NOTA\s+FISCAL",
    r"NF-?E?\b",
    r"DANFE\b",
    r"CONSULTE",
    r"PROTOCOLO",
    r"DATA\s+(DE\s+)?EMISS",
    r"\d{44}$",
    r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}$",
    r"https?://",
    r"NOME\s+CPF",
    r"NOME\s+CNPJ",
    r"RAZ.O\s+SOCIAL\s+CNPJ",
    r"CPF/CNPJ\s+VENCIMENTO",
    r"CPF/CNPJ\s+INSCRI",
    r"VENCIMENTO\s+VALOR",
    r"SEUS\s+DADOS",
    r"TIM\s*S?\.{2,}",
    r"BETIM\s*/\s*MG",
    r"\w+\s*/\s*[A-Z]{2}\s*-?\s*CEP",
    r"N[ºO]\s+DO\s+CLIENTE",
    r"\(-?\)\s*DESCONTO",
    r"ABATIMENTOS",
    r"OUTRAS\s+DEDU",
    r"-?\s*INSC\.?\s*EST\.?",
    r"FATURA\s+DE\s+SERVI",
)
# Streets, and words of company names.
STREETS = ("RUA ", "AV ", "AV.", "AVENIDA ", "RODOVIA ", "BR ", "ESTRADA ", "PRAÇA ", "PRACA ")
COMPANY_WORDS = ("LTDA", "S.A", "S/A", "SA ", "ME ", "EPP", "EIRELI", "TELECOM", "COMUNICAC", "SERVICO", "TECNOLOGIA")
# Labels on a slip's line.
SLIP_LABELS = (
    r"BENEFICI[ÁA]RIO",
    r"VENCIMENTO",
    r"VALOR\s+DO\s+DOCUMENTO",
    r"VALOR\s+DOCUMENTO",
    r"AG[EÊ]NCIA\s*/\s*C[ÓO]DIGO",
    r"RECIBO\s+DE\s+ENTREGA",
    r"COMPROVANTE\s+DE\s+ENTREGA",
    r"PAGADOR",
    r"NOSSO\s+N[ÚU]MERO",
)
# Words too common to be an own company's code in a name.
COMMON_NAME_WORDS = (
    "SERVICO",
    "SERVICOS",
    "CONSULTORIA",
    "GESTAO",
    "INTEGRADA",
    "COMERCIO",
    "INDUSTRIA",
    "TECNOLOGIA",
    "SOLUCOES",
    "SISTEMA",
    "SISTEMAS",
    "EMPRESA",
    "EMPRESAS",
    "ADMINISTRACAO",
    "ADMINISTRADORA",
    "PARTICIPACOES",
    "GRUPO",
    "HOLDING",
    "COMPANHIA",
    "CIA",
    "LTDA",
    "SA",
    "S/A",
    "MINAS",
    "GERAIS",
    "PAULO",
    "JANEIRO",
    "BAHIA",
    "GOIAS",
    "BRASIL",
    "NACIONAL",
    "REGIONAL",
    "FEDERAL",
    "ESTADUAL",
    "NORTE",
    "SUL",
    "LESTE",
    "OESTE",
    "CENTRO",
    "CENTRAL",
    "PORTAL",
    "DIGITAL",
    "TELECOM",
)
# Bank receipts, and what is none.
RECEIPT_STRONG = (
    r"COMPROVANTE\s+DE\s+TRANSFER[EÊ]NCIA",
    r"COMPROVANTE\s+DE\s+PAGAMENTO",
    r"COMPROVANTE\s+(?:TED|PIX|DOC)\b",
    r"DADOS\s+DE\s+QUEM\s+EST[AÁ]\s+PAGANDO",
    r"DADOS\s+DE\s+QUEM\s+EST[AÁ]\s+RECEBENDO",
    r"TRANSFER[EÊ]NCIA\s+(?:ENTRE\s+CONTAS|REALIZADA)",
    r"(?:TED|PIX|DOC)\s+(?:REALIZADO|EFETUADO|AGENDADO)",
    r"TIPO\s+DE\s+CONTA\s+CONTA[_\s]?CORRENTE",
)
RECEIPT_WEAK = (
    r"AG[EÊ]NCIA\s+E\s+CONTA",
    r"IDENTIFICA[CÇ][AÃ]O\s+NO\s+EXTRATO",
    r"CONTA[_\s]?CORRENTE",
    r"CONTA[_\s]?POUPAN[CÇ]A",
    r"FAVORECIDO",
    r"ORDENANTE",
    r"BENEFICI[AÁ]RIO",
)
RECEIPT_BANKS = ("ITA[UÚ]", "BRADESCO", "BANCO DO BRASIL", "SANTANDER", "CAIXA", "CEF", "SICOOB", "SICREDI", "INTER", "NUBANK", "C6", "BTG", "SAFRA", "ORIGINAL", "BANRISUL", "BRB", "UNICRED")
NO_RECEIPT = (
    r"NOTA\s+FISCAL",
    r"NFS-?E",
    r"DANFE",
    r"BOLETO",
    r"FATURA\s+DE\s+SERVI[CÇ]O",
    r"PREFEITURA\s+MUNICIPAL",
    r"SECRETARIA\s+(?:MUNICIPAL\s+)?(?:DA\s+)?FAZENDA",
    r"NOTA\s+DE\s+D[EÉ]BITO",
)
# How a paid transfer's file is called, and its subtypes.
PAID_FILES = ("COMP PGTO", "COMPROVANTE", "TED_", "PIX_")
PAID_SUBTYPES = ("COMPROVANTE_BANCARIO", "TED", "DOC", "PIX")

# What makes a text a heading or label and no name. Those of the first list count with and without accents. An
# entry that holds another one is not repeated.
LABEL_WORDS_BOTH = (
    "CÓD.", "ESPÉCIE", "NOSSO NÚMERO", "AGÊNCIA", "NÚMERO DO DOCUMENTO", "INSCRIÇÃO MUNICIPAL", "PRESTADOR DE SERVIÇOS", "PRESTADOR DO SERVIÇO", "TOMADOR DO SERVIÇO",
    "ÓRGÃOS DE PROTEÇÃO", "BENEFICIÁRIO", "FICHA DE COMPENSAÇÃO", "AUTENTICAÇÃO MECÂNICA", "PRAÇA ", "NOTA DE DÉBITO", "( ) NÃO EXISTE", "( ) NÃO PROCURADO",
)
LABEL_WORDS = (
    "VENCIMENTO", "VALOR DO DOCUMENTO", "COOPERATIVA", "CÓDIGO", "CARTEIRA", "ACEITE", "PROCESSAMENTO", "CONTA", "DOCUMENTO(S)", "DOCUMENTOS",
    "QUANTIDADE (=) VALOR", "QUANTIDADE VALOR", "DESCONTO", "ABATIMENTO", "OUTRAS DEDUÇÕES", "MORA / MULTA", "OUTROS ACRÉSCIMOS", "VALOR COBRADO",
    "(=)", "(-)", "(+)", "PAGAMENTO", "SEGURO", "ASSEGURA", "FORMA,", "DESSA FORMA", "CPF OU CNPJ", "CPF/CNPJ", "E-MAIL", "ENDEREÇO", "MUNICÍPIO", "CEP ",
    "DOCUMENTO AUXILIAR", "NOTA FISCAL FATURA", "FATURA DE SERVIÇOS DE COMUNICAÇÃO", "DADOS DA CONTRATANTE", "DADOS DA CONTRATADA", "QUALIFICAÇÃO DA CONTRATADA",
    "RAZÃO SOCIAL", "ESTE DOCUMENTO NÃO", "NÃO QUITA", "DÉBITOS ANTERIORES", "SERVIÇO ALÉM DA GARANTIA", "CRECI:", "INSCRITA NO CNPJ", "INSCRITO NO CNPJ", "UTILIDADE",
    "NOME EMPRESARIAL", "MUNICIPIO CEP", "- ENDERECO", "TAXID", "TAX ID", "USA ", "FLORIDA", "MUDOU-SE", "MUDOU SE", "/ -1 1 (", ") MUDOU", "EMITENTE DA NFS-E", "EMITENTE DA NFSE",
    "RECEBEDOR", ".COM.BR ", ".NET.BR ", "DIAS VENCIDO", "SERÁ SUSPENSO", "SERVIÇO SERÁ", "INCLUSÃO NOS", "SERASA", "PROTESTO", "COBRANÇA JUDICIAL", "MULTA DE", "JUROS DE",
    "CEDENTE", "SACADO", "PAGADOR", "RECIBO DO", "RUA ", "AVENIDA ", "AV. ", "AV ", "TRAVESSA ", "ALAMEDA ", "RODOVIA ", "ESTRADA ", "Nº ", "N° ", " - CENTRO", " - BAIRRO",
    "CEP -", "CEP:", "COMPLEMENTO BAIRRO", "PRAIA DO FUTURO", "17 ANDAR", "EDIF ", "EDIFICIO ", "COD. DE AUTENTICIDADE", "CODIGO DE AUTENTICIDADE", "VALOR DA CAUSA", "NO INTERNET BANKING",
    "DDA O SACADO", "SERA PJBANK", "FAVORECIDO:", "NOME FANTASIA", "SISTEMAS LTDA", "@GMAIL", "@HOTMAIL", "@OUTLOOK", "@YAHOO", "WWW.", "CNPJ/MF SOB", "CONTAS A RECEBER", "CONTAS A PAGAR",
    "CENTRO NOVO HAMBURGO", "PC PRESIDENTE", "= CNPJ", "| CNPJ", "- CNPJ", "CONTATO CNPJ", "AO ASSINAR", "ASSINATURA", "DECLARO QUE", "CONCORDO COM", "( ) AUSENTE", "( ) RECUSADO", "( ) ENDERECO INSUFICIENTE",
    "( ) DESCONHECIDO", "( ) FALECIDO", "( ) OUTROS", "COMPROVANTE DE ENTREGA",
)
#: States whose mark ends an address, as "/MG)" or "/ MG".
LABEL_STATES = ("MG", "SP", "RJ", "PR", "SC", "RS", "BA", "GO", "DF")

# Administrative documents, in upper case without accents and with single blanks: what they are called, and the phrases of each.
ADMIN_KINDS = {
    "Lembrete administrativo": ("LEMBRETE GENTIL", "LEMBRE GENTIL"),
    "Ordem de serviço/agendamento": ("ORDEM DE SERVICO",),
    "Documento de rescisão contratual": ("RESCISAO CONTRATUAL", "RESCISORIO"),
    "Documento de encerramento de contrato": ("ENCERRAMENTO DE CONTRATO", "SOLICITACAO DE ENCERRAMENTO"),
    "Documento de cancelamento": ("CANCELAMENTO DE CONTRATO",),
    "Notificação automática": ("NOTIFICACAO AUTOMATICA",),
    "GRU - Guia de Recolhimento da União": ("GUIA DE RECOLHIMENTO DA UNIAO", "PAGTESOURO"),
    "Guia de custas judiciais": ("GUIA CUSTAS", "CUSTAS JUDICIAIS", "CUSTAS PROCESSUAIS"),
    "Documento de contrato": ("CONTRATO SITE", "CONTRATO MASTER", "CONTRATO RENOVACAO", "CONTRATO ADITIVO", "CONTRATO_SITE", "CONTRATO_MASTER", "CONTRATO_RENOVACAO", "CONTRATO_ADITIVO", "MINUTA DE CONTRATO", "CONTRATO DE ALUGUEL", "CONTRATO DE LOCACAO", "CONTRATO DE PRESTACAO", "CONTRATO DE SERVICO"),
    "Demonstrativo": ("DEMONSTRATIVO DE PAGAMENTO", "DEMONSTRATIVO DE FATURAMENTO", "DEMONSTRATIVO FINANCEIRO", "DEMONSTRATIVO MENSAL", "DEMONSTRATIVO DETALHADO"),
    "Proposta comercial": ("PROPOSTA COMERCIAL", "PROPOSTA DE SERVICO"),
    "Proposta técnica": ("PROPOSTA TECNICA",),
    "Orçamento/proposta": ("ORCAMENTO",),
    "Termo/acordo": ("TERMO DE ACEITE", "TERMO DE ADESAO", "TERMO DE COMPROMISSO", "TERMO DE RESPONSABILIDADE"),
    "SLA/Acordo": ("ACORDO DE NIVEL DE SERVICO",),
    "Relatório/planilha de conferência": ("RELATORIO DE FATURAMENTO", "PLANILHA DE CONFERENCIA", "PLANILHA DE FATURAMENTO"),
    "Documento de programação/câmbio": ("CAMBIO HBO", "CAMBIO GLOBOSAT", "CAMBIO BAND", "CAMBIO SBT", "CAMBIO RECORD", "CAMBIO PROGRAMADORA", "CAMBIO MTV", "PROGRAMADORA BRASILEIRA", "BOX BRAZIL"),
    "Processo jurídico": ("PROCESSO FISCAL", "PROCESSO TRABALHISTA", "PROCESSO TRABALHISTO", "PROCESSO JUDICIAL"),
    "Execução fiscal/judicial": ("EXECUCAO FISCAL", "EXECUCAO TRABALHISTA", "EXECUCAO TRABALHISTO", "EXECUCAO JUDICIAL"),
    "Taxa/anuidade de órgão": ("ANUIDADE CREA", "ANUIDADE OAB", "ANUIDADE CRM", "ANUIDADE CFM", "ANUIDADE COREN"),
    "Reembolso interno": ("REEMBOLSO DE TARIFAS", "REEMBOLSO DAS TARIFAS"),
    "Documento de tarifas internas": ("TARIFAS CSC", "TARIFAS APURADAS", "BOLETOS RECEBIDOS NO CSC"),
    "Documento de condomínio": ("ALVIM NOGUEIRA",),
    "Reclamação de cobrança": ("COBRANCA INDEVIDA",),
    "Comprovante administrativo": ("COMPROVANTE DE SOLICITACAO",),
    "Atestado/declaração": ("ATESTADO DE CAPACIDADE", "ATESTADO TECNICO", "DECLARACAO DE SERVICOS"),
    "Relatório": ("RELATORIO DE ATIVIDADES", "RELATORIO MENSAL"),
    "Relatório técnico": ("RELATORIO TECNICO",),
    "Documento informativo de serviço público": ("INFORMATIVO IMPORTANTE",),
    "Documento de serviço público": ("SERVICO PUBLICO", "CONTA AGUA", "CONTA LUZ", "CONTA ENERGIA", "CONTA TELEFONE", "CONTA DE AGUA", "CONTA DE LUZ", "CONTA DE ENERGIA", "CONTA DE TELEFONE"),
}
#: The same where a phrase is no plain text.
ADMIN_SHAPES = {
    "Ordem de serviço/agendamento": (r"SUA ORDEM .*AGENDAD[OA]", r"N[º°.]? ?\d+[- ]AGENDAMENTO"),
    "Documento de distrato": (r"\bDISTRATO\b",),
    "Notificação automática": (r"DOCUMENTO \d{6,9} [-–] NOTIFICACAO", r"DOCUMENTO ?: ?\d{6,9}"),
    "Guia jurídica/fiscal": (r"GUIA ?[|–-] ?(?:PROCESSO|EXECUCAO)", r"GUIAS? ?[–-]? ?(?:CSC|PROCESSO|EXECUCAO)"),
    "GRU - Guia de Recolhimento da União": (r"\bGRU\b.*TESOURO", r"CODIGO DE RECOLHIMENTO \d+"),
    "Demonstrativo": (r"DEMONSTRATIVO DE SERVICOS(?! DE LOCA)",),
    "SLA/Acordo": (r"\bSLA\b",),
    "Invoice internacional": (r"(?:DECEMBER|JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER) ?[–-]? ?\d{4} INVOICE FOR",),
    "Recibo de pagamento": (r"RECIBO NUMERO ?[:-]? ?\d+", r"RECEBI ?\(?EMOS\)? DE ?:", r"A IMPORTANCIA DE ?:", r"REFERENTE A ?: ?CREDITO"),
}
# Subtypes, the first whose phrase occurs; a name of a phrase list, or phrases of its own.
ADMIN_SUBTYPES = (
    ("LEMBRETE", "Lembrete administrativo", r"LEMBR(?:ETE|E) GENTIL"),
    ("ORDEM_SERVICO", "Ordem de serviço/agendamento", r"SUA ORDEM .*AGENDAD[OA]|ORDEM DE SERVICO"),
    ("DISTRATO", "Documento de distrato", r"\bDISTRATO\b"),
    ("RESCISAO", "Documento de rescisão contratual", r"RESCISAO CONTRATUAL"),
    ("ENCERRAMENTO", "Documento de encerramento de contrato", r"ENCERRAMENTO DE CONTRATO|SOLICITACAO DE ENCERRAMENTO"),
    ("NOTIFICACAO", "Notificação automática", r"NOTIFICACAO AUTOMATICA"),
    ("GUIA_JURIDICA", "Guia jurídica/fiscal", r"GUIA ?[|–-] ?(?:PROCESSO|EXECUCAO)"),
    ("CONTRATO", "Documento de contrato", r"CONTRATO[_ ](?:SITE|MASTER|RENOVACAO|ADITIVO)"),
    ("INVOICE_INTERNACIONAL", "Invoice internacional", ADMIN_SHAPES["Invoice internacional"][0]),
    ("RELATORIO", "Relatório/planilha de conferência", r"RELATORIO DE FATURAMENTO|PLANILHA DE (?:CONFERENCIA|FATURAMENTO)"),
    ("CAMBIO", "Documento de programação/câmbio", r"CAMBIO (?:HBO|GLOBOSAT|BAND|SBT|RECORD|PROGRAMADORA)"),
    ("CONDOMINIO", "Documento de condomínio", r"ALVIM NOGUEIRA"),
    ("RECLAMACAO", "Reclamação de cobrança", r"COBRANCA INDEVIDA"),
    ("REEMBOLSO", "Reembolso interno", r"REEMBOLSO DE TARIFAS"),
    ("TARIFAS_INTERNAS", "Documento de tarifas internas", r"TARIFAS CSC"),
)
# Marks of fiscal documents and slips; two of them, or the access key alone, and a document is not administrative.
ADMIN_NOT = (
    "CHAVE DE ACESSO", "PROTOCOLO DE AUTORIZACAO", "CONSULTE PELA CHAVE DE ACESSO", "PIS/COFINS", "BOX BRAZIL", "ITENS DA FATURA", "UN QUANT PRECO UNIT", "PREFEITURA MUNICIPAL DE",
    "SECRETARIA MUNICIPAL FAZENDA", "SECRETARIA MUNICIPAL DA FAZENDA", "TOMADOR DE SERVICOS", "PRESTADOR DE SERVICOS", "NOTA FISCAL ELETRONICA DE SERVICOS", "RECIBO DO SACADO", "VALOR DO DOCUMENTO",
    "BOLETO", "LINHA DIGITAVEL", "BENEFICIARIO", "SACADO", "CEDENTE", "NOSSO NUMERO", "AGENCIA", "CONTA CORRENTE", "ACIMOC", "ASSOCIACAO COMERCIAL INDUSTRIAL", "MUGO TELECOM",
    "DOCUMENTO AUXILIAR DA NOTA FISCAL", "DOCUMENTO AUXILIAR DA NFS",
)
ADMIN_NOT_SHAPES = (
    r"\b\d{44}\b", r"QR ?CODE P(?:ARA)? ?PAGAMENTO PIX", r"^NOTA FISCAL FATURA:? ?\d+", r"^FATURA (?:DE )?SERVICOS? ?\d+", r"^NFS[E-]? ?\d+", r"^NF COM ?\d+", r"VALOR (?:DO )?SERVICO\b", r"BASE DE CALCULO\b",
    r"IMPOSTO (?:SOBRE )?SERVICOS?\b", r"ISS\b.*\bR\$ ?[\d.]+,\d{2}", r"ICMS\b", r"TELCABLES BRASIL.*NOTA FISCAL", r"TCF TELECOM.*NOTA FISCAL", r"BOX BRAZIL.*FATURAMENTO", r"FATURAMENTO.*BOX BRAZIL", r"BOX BRAZIL.*FATURA:",
    r"BOX BRAZIL.*- ?[A-Z]{3} ?- ?[A-Z]+", r"CNTINT\d+ ?- ?IP TRANSIT", r"AUTENTICIDADE [A-Z0-9-]+", r"IM:\d+", r"IE:\d+", r"PRO ?-? ?PAINEL",
)
ADMIN_SLIP = ("RECIBO DO SACADO", "VALOR DO DOCUMENTO", "BOLETO", "LINHA DIGITAVEL", "BENEFICIARIO", "SACADO", "CEDENTE", "NOSSO NUMERO", "AGENCIA", "CONTA CORRENTE", "PAGADOR", "VENCIMENTO", "VALOR A PAGAR")
ADMIN_WORDS = ("SOLICITAÇÃO", "AVISO", "NOTIFICAÇÃO", "INFORMAÇÃO", "COMUNICADO", "ORIENTAÇÃO", "LEMBRETE", "AGENDAMENTO", "CONFIRMAÇÃO", "STATUS", "ANDAMENTO")
# Suppliers known from service orders, first match wins.
ORDER_SUPPLIERS = (
    (r"GLOBENET\s+CABOS\s+SUBMARINOS\s+S\.?A\.?|\bGLOBENET\b", "GlobeNet Cabos Submarinos S.A."), (r"\bVTAL\b", "VTAL"), (r"\bEQUINIX\b", "EQUINIX"),
    (r"LUMEN\s+TECHNOLOGIES", "LUMEN TECHNOLOGIES"), (r"AMERICAN\s+TOWER", "AMERICAN TOWER DO BRASIL"),
)

# Words of companies' names that readers run together; each counts with and without accents.
NAME_WORDS = (
    "TELECOMUNICAÇÕES", "TELECOMUNICAÇÃO", "DESENVOLVIMENTO", "COMPARTILHADOS", "COMPARTILHADO", "INTERMEDIAÇÃO", "ADMINISTRAÇÃO", "ADMINISTRADORA", "INVESTIMENTOS", "INVESTIMENTO", "PARTICIPAÇÕES", "PARTICIPAÇÃO",
    "INTELIGÊNCIA", "COMUNICAÇÕES", "COMUNICAÇÃO", "ESTRATÉGICA", "ESTRATÉGICO", "ESCRITÓRIOS", "ESCRITÓRIO", "CONSULTORIA", "PERFORMANCE", "PERFOMANCE", "INFORMÁTICA", "AUDIOVISUAL", "TECNOLOGIA", "TECHNOLOGY", "ARTIFICIAL",
    "ASSESSORIA", "AUDITORIA", "ASSOCIADOS", "ASSOCIADO", "ADVOGADOS", "ADVOGADO", "CONCEITOS", "CONCEITO", "SOFTWARE", "SERVIÇOS", "SERVIÇO", "SOLUÇÕES", "SOLUÇÃO", "SISTEMAS", "SISTEMA", "PROJETOS", "PROJETO", "INTERNET",
    "PARTNERS", "SUPORTE", "DIGITAL", "CONEXÃO", "SERVICE", "GESTÃO", "BRASIL", "FOCUS", "APOIO", "IDEAL", "BENS",
)

# Links in mail that name no company, and domains of mail providers.
MAIL_LINKS = (r"https?://(?:click|track|cdn)\.\S+", r"https?://\S*\.cdn\.\S+", r"https?://\S+/(?:track|click)/\S+", r'(?:href|src)="[^"]*"')
MAIL_PROVIDERS = ("gmail.com", "outlook.com", "hotmail.com", "yahoo.com", "yahoo.com.br")
# Words of companies' names that name none in a mail.
MAIL_STOPWORDS = (
    "SERVICO", "SERVICOS", "SERVICE", "CONSULTORIA", "GESTAO", "INTEGRADA", "COMERCIO", "INDUSTRIA", "TECNOLOGIA", "SOLUCOES", "SISTEMA", "SISTEMAS", "EMPRESA", "EMPRESAS", "ADMINISTRACAO", "ADMINISTRADORA", "PARTICIPACOES", "SOCIETARIAS",
    "GRUPO", "HOLDING", "COMPANHIA", "CIA", "LTDA", "SA", "S/A", "EIRELI", "EPP", "ME", "PROVEDOR", "ACESSO", "INTERNET", "TELECOM", "TELECOMUNICACOES", "COMUNICACAO", "MATRIZ", "FILIAL", "BRASIL", "BRASILEIRA", "REDE",
    "CLICK", "TRACK", "VIEW", "OPEN", "LINK", "HTTP", "HTTPS", "WWW", "STYLE", "WIDTH", "HEIGHT", "FONT", "ALIGN", "CENTER", "LEFT", "RIGHT", "VISTA", "ALEGRE", "PAULO", "SAO",
)
# Labels before the company a mail is for, and before words that are none.
MAIL_FOR = (r"(?:PARA|TO):[^<]*", r"(?:TOMADOR|DESTINAT[ÁA]RIO|CLIENTE)[:\s].*")
MAIL_SECRET = r"(?:FRASE\s+DE\s+SEGURAN[ÇC]A|SENHA|PASSWORD|SECURITY\s+PHRASE)[^:]*:.*"

# Numbers of notes and bills in a mail, first match wins.
MAIL_NUMBERS = (
    r"\b[Ff]atura\s*(?:N[ºo°]\.?\s*)?[:\s]*(\d{3,10})\b", r"\bNF(?:-?[Ee])?\s*[:\s]*(\d{3,15})\b", r"\bNFS-?[Ee]\s*[:\s]*(\d{3,15})\b", r"\b[Nn]ota\s+[Ff]iscal\s*(?:N[ºo°]\.?\s*)?[:\s]*(\d{3,15})\b",
    r"\bN[ºo°]\.?\s*[:\s]*(\d{3,10})\b", r"\b[Nn][úu]mero\s*[:\s]*(\d{3,10})\b", r"\b[Dd]oc(?:umento)?\.?\s*[:\s]*(\d{3,10})\b", r"(?i)(?:nota|fatura|nf)[^\d]{0,10}(20\d{2}[/\-]\d{1,6})\b",
)
