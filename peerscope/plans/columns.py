"""Field names of the yearly energy reports and of the school directory."""

# --- fixed values: for each field the header variants, preferred first ----------------------------
ENERGY_ALIASES = {
    "sector": ["sector name", "sector"],
    "organization_name": ["organization name", "organization"],
    "facility_name": ["operation name", "operation", "property name"],
    "source_facility_identifier": ["portfolio manager property id"],
    "operation_type": ["operation type", "primary property type self selected"],
    "street": ["address"],
    "city": ["city"],
    "postal_code": ["postal code"],
    "reporting_year": ["year"],
    "year_ending": ["year ending"],
    "floor_area_m2": ["property gfa self reported m2"],
    "floor_area_quantity": ["total floor area", "total indoor space x"],
    "floor_area_unit": ["unit1", "unit of measure", "unit"],
    "weekly_hours": ["average hours per week", "weekly average hours"],
    "portable_count": ["number of portables"],
    "electricity_kwh": ["electricity use grid purchase kwh"],
    "electricity_gj": ["electricity use grid purchase gj"],
    "electricity_quantity": ["electricity", "electricity quantity"],
    "electricity_unit": ["unit2", "electricity unit"],
    "natural_gas_gj": ["natural gas use gj"],
    "natural_gas_quantity": ["natural gas", "naturalgas quantity"],
    "natural_gas_unit": ["unit3", "naturalgas unit", "natural gas2"],
    "fuel_oil_1_gj": ["fuel oil 1 use gj"],
    "fuel_oil_2_gj": ["fuel oil 2 use gj"],
    "fuel_oil_4_gj": ["fuel oil 4 use gj"],
    "fuel_oil_5_6_gj": ["fuel oil 5 and 6 use gj"],
    "diesel_gj": ["diesel use gj"],
    "kerosene_gj": ["kerosene use gj"],
    "propane_gj": ["propane use gj"],
    "district_steam_gj": ["district steam use gj"],
    "district_hot_water_gj": ["district hot water use gj"],
    "district_chilled_water_gj": ["district chilled water use gj"],
    "wood_gj": ["wood use gj"],
    "total_site_energy_gj": ["site energy use gj"],
    "reported_eui_gj_m2": ["energy intensity gj m2", "site eui gj m2"],
    "normalized_total_energy_gj": ["weather normalized site energy use gj"],
    "ghg_kg_co2e": ["ghg emissions kg"],
    "ghg_tonnes_co2e": ["total location based ghg emissions metric tons co2e"],
    "custom_1_name": ["custom property id 1 name"],
    "custom_1_value": ["custom property id 1 value"],
    "custom_2_name": ["custom property id 2 name"],
    "custom_2_value": ["custom property id 2 value"],
    "custom_3_name": ["custom property id 3 name"],
    "custom_3_value": ["custom property id 3 value"],
}
ENERGY_REQUIRED = ["organization_name", "facility_name"]
FUEL_OIL_FIELDS = ["fuel_oil_1_gj", "fuel_oil_2_gj", "fuel_oil_4_gj", "fuel_oil_5_6_gj"]
OTHER_ENERGY_FIELDS = [
    "diesel_gj",
    "kerosene_gj",
    "propane_gj",
    "district_steam_gj",
    "district_hot_water_gj",
    "district_chilled_water_gj",
    "wood_gj",
]
DIRECTORY_ALIASES = {
    "region": ["region"],
    "board_number": ["board number"],
    "board_name": ["board name"],
    "board_type": ["board type"],
    "board_language": ["board language"],
    "board_website": ["board website"],
    "school_number": ["school number"],
    "name": ["school name"],
    "school_level": ["school level"],
    "language": ["school language"],
    "school_type": ["school type"],
    "special_conditions": ["school special conditions"],
    "street": ["street"],
    "city": ["city"],
    "province": ["province"],
    "postal_code": ["postal code"],
    "grade_range": ["grade range"],
    "website": ["website", "school website"],
}
DIRECTORY_REQUIRED = ["board_number", "board_name", "school_number", "name"]
COORDINATE_ALIASES = {"school_number": ["school number"], "latitude": ["latitude"], "longitude": ["longitude"]}
SCHOOL_BOARD_MARKERS = ("school board", "conseil scolaire", "school authority")
ENERGY_DATASET = "ontario-bps-energy-ghg"
DIRECTORY_DATASET = "ontario-public-school-contact-information"
