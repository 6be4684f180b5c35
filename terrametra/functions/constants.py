"""Results depend on these exact lists, codes and thresholds."""

from __future__ import annotations

# Two-digit activity prefix -> macro sector.
SECTOR_BY_PREFIX = {
    "11": "Industria", "21": "Industria", "22": "Industria", "23": "Industria",
    "31": "Industria", "32": "Industria", "33": "Industria",
    "43": "Comercio", "46": "Comercio",
    "48": "Servicios", "49": "Servicios", "51": "Servicios", "52": "Servicios",
    "53": "Servicios", "54": "Servicios", "55": "Servicios", "56": "Servicios",
    "61": "Servicios", "62": "Servicios", "71": "Servicios", "81": "Servicios",
    "93": "Servicios",
    "72": "Alimentos",
}
DEFAULT_SECTOR = "Servicios"
SECTORS = ["Comercio", "Servicios", "Industria", "Alimentos"]

# Employment band -> point estimate.
EMPLOYMENT_BANDS = {
    "0 a 5 personas": 3, "6 a 10 personas": 8, "11 a 30 personas": 20, "31 a 50 personas": 40,
    "51 a 100 personas": 75, "101 a 250 personas": 175, "251 y más personas": 400,
}
DEFAULT_EMPLOYMENT = 3

# Abbreviations in official municipality names.
NAME_ABBREVIATIONS = {"GRAL": "GENERAL", "PTE": "PRESIDENTE", "DR": "DOCTOR", "STA": "SANTA"}

# Indicator activities by official activity name.
INDICATOR_ACTIVITIES = {
    "☕ Café/neverías": ["CAFETERIAS"],
    "🍺 Bar/cantina": ["BARES, CANTINAS"],
    "🐕 Veterinaria": ["VETERINARIOS PARA MASCOTAS"],
    "💈 Estética/belleza": ["SALONES Y CLINICAS DE BELLEZA"],
    "🏋 Gimnasio": ["DEPORTIVOS", "GIMNASIO", "ACONDICIONAMIENTO FISICO"],
    "🎨 Galería/arte": ["GALERIAS", "OBRAS DE ARTE"],
}

# Indicator activities of the municipal roll-up (upper case, not folded).
ROLLUP_INDICATORS = [
    "CAFETERIAS", "BARES, CANTINAS", "VETERINARIOS PARA MASCOTAS", "SALONES Y CLINICAS DE BELLEZA",
    "GIMNASIO", "ACONDICIONAMIENTO FISICO", "GALERIAS",
]

# Indicator species by business name (two registry cuts).
INDICATOR_SPECIES = {
    "Café de especialidad": ["CAFE", "COFFEE", "TOSTADOR", "ESPRESSO"],
    "Coworking": ["COWORK", "OFICINAS COMPARTIDAS", "WEWORK"],
    "Galería": ["GALERIA", "ARTE CONTEMPOR"],
    "Barbería premium": ["BARBER", "BARBERIA"],
    "Estudio de yoga": ["YOGA", "PILATES"],
    "Panadería artesanal": ["ARTESANAL", "SOURDOUGH", "MASA MADRE"],
    "Veterinaria": ["VETERINAR", "PET SHOP", "ESTETICA CANINA"],
    "Gym boutique": ["CROSSFIT", "BOX FIT", "CYCLING", "BARRE"],
}

# Business lines for site selection, by business name.
BUSINESS_LINES = {
    "Farmacia": ["FARMACIA"],
    "Cafetería": ["CAFE", "CAFETERIA"],
    "Gimnasio": ["GIMNASIO", "GYM", "FITNESS", "CROSSFIT"],
    "Veterinaria": ["VETERINAR"],
    "Panadería": ["PANADERIA"],
    "Ferretería": ["FERRETER"],
    "Lavandería": ["LAVANDER"],
    "Consultorio dental": ["DENTAL", "DENTISTA", "ODONTO"],
    "Papelería": ["PAPELER"],
    "Tortillería": ["TORTILLER"],
    "Gasolinera": ["GASOLINER", "COMBUSTIBLE", "ESTACION DE SERVICIO", "PEMEX"],
    "Autolavado": ["AUTOLAVADO", "CAR WASH", "LAVADO DE AUTOS"],
    "Guardería": ["GUARDERIA", "ESTANCIA INFANTIL"],
    "Refaccionaria": ["REFACCION"],
}

# Canary lines, by business name.
CANARY_LINES = {
    "Café de especialidad": ["CAFE"],
    "Barbería": ["BARBER"],
    "Galería / arte": ["GALERIA", "ARTE "],
    "Yoga / pilates": ["YOGA", "PILATES"],
    "Coworking": ["COWORK"],
    "Cerveza artesanal / vinoteca": ["CERVEC", "VINOT", "TAP ROOM"],
    "Panadería artesanal": ["PANADER"],
}

# Offences of the incidence file and the months of its wide layout.
OFFENCES = {
    "homicidio doloso": "homicidio",
    "robo a casa habitacion": "robo_casa",
    "robo de vehiculo automotor": "robo_vehiculo",
    "extorsion": "extorsion",
}
MONTHS = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
]

# Drought levels and labels.
DROUGHT_LEVELS = {"": 0, "d0": 1, "d1": 2, "d2": 3, "d3": 4, "d4": 5}
DROUGHT_LABELS = [
    "Sin sequía", "D0 - anormalmente seco", "D1 - sequía moderada",
    "D2 - sequía severa", "D3 - sequía extrema", "D4 - sequía excepcional",
]

# Forecast weights (last-year, three-year, national, neighbour rate) and band factors.
SPATIAL_WEIGHTS = {1: (0.18, 0.06, 0.01, 0.75), 3: (0.34, 0.01, 0.03, 0.62)}
BASE_WEIGHTS = (0.5, 0.3, 0.2)
BAND_FACTOR = {1: 2.0, 3: 1.85}

# Reference exchange rate of listings.
USD_MXN = 17.5

# Public listing fields.
PUBLIC_LISTING_FIELDS = [
    "id", "url", "titulo", "precio", "moneda", "operacion", "tipo", "colonia", "municipio", "estado",
    "m2_construccion", "m2_terreno", "recamaras", "banos", "estacionamientos", "lat", "lng", "imagen", "afiliado",
]

# Fields kept from a financial lead.
LEAD_FIELDS = [
    "fecha", "nombre", "telefono", "edad", "edadRetiro", "ingresoMensual", "ahorroAcumulado", "ahorroMensual",
    "cotizaImss", "aniosCotizados", "tasaReemplazo", "edadFin", "pensionEstimada", "brechaMensual",
    "capitalObjetivo", "proyeccionActual", "coberturaMeta", "aportacionPlan", "aportacionManual", "cargaIngreso",
    "ahorroFiscal", "origen", "ref",
]

# National bounding box of the postal index.
NATIONAL_BOX = (14.0, 33.0, -119.0, -86.0)  # lat_min, lat_max, lng_min, lng_max

# Currency spellings counted as national currency in contracts.
NATIONAL_CURRENCY = ["mxn", "pesos", "mn", "peso mexicano"]
