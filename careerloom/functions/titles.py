"""Rules that give an occupation's title its function, and categories of résumés theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of titles and their functions; the first that matches counts, and case matters.
SIGNAL_RULES = (
    (r"\bSoftware\b", "technology"), (r"\bDeveloper", "technology"), (r"\bEngineer(?!$)", "technology"), (r"\bComputer\b", "technology"),
    (r"\bProgrammer", "technology"), (r"\bIT\b", "technology"), (r"\bNetwork", "technology"), (r"\bDatabase", "technology"),
    (r"\bMarketing\b", "marketing"), (r"\bSales\b", "sales"), (r"\bTeacher", "education"), (r"\bInstructor", "education"),
    (r"\bEducation", "education"), (r"\bProfessor", "education"), (r"\bSchool\b", "education"), (r"\bLibrarian", "education"),
    (r"\bNurse", "healthcare"), (r"\bMedical\b", "healthcare"), (r"\bHealth\b", "healthcare"), (r"\bClinical\b", "healthcare"),
    (r"\bPhysician", "healthcare"), (r"\bTherapist", "healthcare"), (r"\bDental\b", "healthcare"), (r"\bPharmacy", "healthcare"),
    (r"\bDesigner", "design"), (r"\bDesign\b", "design"), (r"\bGraphic\b", "design"), (r"\bArtist", "design"), (r"\bClerk", "administrative"),
    (r"\bReceptionist", "administrative"), (r"\bSecretar", "administrative"), (r"\bOffice\b", "administrative"), (r"\bAccountant", "finance"),
    (r"\bFinancial\b", "finance"), (r"\bAuditor", "finance"), (r"\bBudget", "finance"), (r"\bChef\b", "food-service"),
    (r"\bCook(?!ing)", "food-service"), (r"\bRestaurant\b", "food-service"), (r"\bKitchen\b", "food-service"), (r"\bFood\b", "food-service"),
    (r"\bBarista", "food-service"), (r"\bBartender", "food-service"), (r"\bWait", "food-service"), (r"\bConstruction\b", "skilled-trade"),
    (r"\bElectrician", "skilled-trade"), (r"\bPlumber", "skilled-trade"), (r"\bCarpenter", "skilled-trade"), (r"\bWelder", "skilled-trade"),
    (r"\bMechanic", "skilled-trade"), (r"\bDriver\b", "logistics"), (r"\bTruck\b", "logistics"), (r"\bWarehouse\b", "logistics"),
    (r"\bDelivery\b", "logistics"), (r"\bManufacturing\b", "manufacturing"), (r"\bProduction\b", "manufacturing"), (r"\bAssembly\b", "manufacturing"),
    (r"\bHotel\b", "hospitality"), (r"\bHospitality\b", "hospitality"), (r"\bLodging", "hospitality"), (r"\bLawyer", "legal"),
    (r"\bAttorney", "legal"), (r"\bParalegal", "legal"), (r"\bLegal\b", "legal"), (r"\bCourt\b", "legal"), (r"\bPolice\b", "protective-service"),
    (r"\bFirefighter", "protective-service"), (r"\bSecurity\b", "protective-service"), (r"\bGuard\b", "protective-service"),
    (r"\bWriter", "arts-media"), (r"\bJournalist", "arts-media"), (r"\bEditor\b", "arts-media"), (r"\bActor", "arts-media"),
    (r"\bMusician", "arts-media"), (r"\bPhotographer", "arts-media"), (r"\bMedia\b", "arts-media"), (r"\bBroadcast", "arts-media"),
    (r"\bJanitor", "building-grounds"), (r"\bCleaner", "building-grounds"), (r"\bMaid", "building-grounds"), (r"\bLandscap", "building-grounds"),
    (r"\bHairdresser", "personal-care"), (r"\bCosmetolog", "personal-care"), (r"\bBarber", "personal-care"), (r"\bFarm", "agriculture"),
    (r"\bAgricultur", "agriculture"), (r"\bScientist", "science"), (r"\bChemist", "science"), (r"\bBiologist", "science"),
    (r"\bLaboratory\b", "science"), (r"\bSocial Work", "social-service"), (r"\bCounselor", "social-service"), (r"\bManager", "ops"),
    (r"\bSupervisor", "ops"), (r"\bDirector\b", "ops"), (r"\bOperations\b", "ops"), (r"\bCustomer Service\b", "support"), (r"\bSupport\b", "support"),
)

# The same for the occupation matcher.
OCCUPATION_RULES = (
    (r"\bSoftware\b", "technology"), (r"\bDeveloper", "technology"), (r"\bEngineer(?!$)", "technology"), (r"\bComputer\b", "technology"),
    (r"\bData\b", "technology"), (r"\bNetwork", "technology"), (r"\bWeb\b", "technology"), (r"\bIT\b", "technology"), (r"\bDatabase", "technology"),
    (r"\bProgrammer", "technology"), (r"\bMarketing\b", "marketing"), (r"\bSales\b", "sales"), (r"\bTeacher", "education"),
    (r"\bInstructor", "education"), (r"\bEducation", "education"), (r"\bTraining\b", "education"), (r"\bProfessor", "education"),
    (r"\bLibrarian", "education"), (r"\bSchool\b", "education"), (r"\bCurriculum\b", "education"), (r"\bNurse", "healthcare"),
    (r"\bMedical\b", "healthcare"), (r"\bHealth\b", "healthcare"), (r"\bClinical\b", "healthcare"), (r"\bPhysician", "healthcare"),
    (r"\bTherapist", "healthcare"), (r"\bDental\b", "healthcare"), (r"\bSurgeon", "healthcare"), (r"\bPharmacy", "healthcare"),
    (r"\bVeterinar", "healthcare"), (r"\bCustomer Service\b", "support"), (r"\bSupport\b", "support"), (r"\bDesigner", "design"),
    (r"\bDesign\b", "design"), (r"\bGraphic\b", "design"), (r"\bArtist", "design"), (r"\bManager", "ops"), (r"\bOperations\b", "ops"),
    (r"\bDirector\b", "ops"), (r"\bSupervisor", "ops"), (r"\bAdministrative\b", "administrative"), (r"\bOffice\b", "administrative"),
    (r"\bClerk", "administrative"), (r"\bReceptionist", "administrative"), (r"\bSecretar", "administrative"), (r"\bAccountant", "finance"),
    (r"\bFinancial\b", "finance"), (r"\bAuditor", "finance"), (r"\bBookkeeping\b", "finance"), (r"\bBudget", "finance"), (r"\bTax\b", "finance"),
    (r"\bChef\b", "food-service"), (r"\bCook(?!ing)", "food-service"), (r"\bRestaurant\b", "food-service"), (r"\bKitchen\b", "food-service"),
    (r"\bFood\b", "food-service"), (r"\bBarista", "food-service"), (r"\bWait", "food-service"), (r"\bHost(?!ler)", "food-service"),
    (r"\bBartender", "food-service"), (r"\bDishwasher", "food-service"), (r"\bConstruction\b", "skilled-trade"), (r"\bElectrician", "skilled-trade"),
    (r"\bPlumber", "skilled-trade"), (r"\bCarpenter", "skilled-trade"), (r"\bWelder", "skilled-trade"), (r"\bHVAC\b", "skilled-trade"),
    (r"\bRoofer", "skilled-trade"), (r"\bDrywall\b", "skilled-trade"), (r"\bMason", "skilled-trade"), (r"\bPainter", "skilled-trade"),
    (r"\bPipefitter", "skilled-trade"), (r"\bMechanic", "skilled-trade"), (r"\bDriver\b", "logistics"), (r"\bTruck\b", "logistics"),
    (r"\bLogistics\b", "logistics"), (r"\bWarehouse\b", "logistics"), (r"\bDelivery\b", "logistics"), (r"\bForklift\b", "logistics"),
    (r"\bManufacturing\b", "manufacturing"), (r"\bProduction\b", "manufacturing"), (r"\bAssembly\b", "manufacturing"),
    (r"\bMachine\b", "manufacturing"), (r"\bMachinist", "manufacturing"), (r"\bQuality Control\b", "manufacturing"),
    (r"\bHospitality\b", "hospitality"), (r"\bHotel\b", "hospitality"), (r"\bMotel\b", "hospitality"), (r"\bResort\b", "hospitality"),
    (r"\bLawyer", "legal"), (r"\bAttorney", "legal"), (r"\bParalegal", "legal"), (r"\bJudge\b", "legal"), (r"\bLegal\b", "legal"),
    (r"\bLaw\b", "legal"), (r"\bWriter", "arts-media"), (r"\bAuthor\b", "arts-media"), (r"\bJournalist", "arts-media"), (r"\bReporter", "arts-media"),
    (r"\bEditor\b", "arts-media"), (r"\bProducer", "arts-media"), (r"\bActor", "arts-media"), (r"\bMusician", "arts-media"),
    (r"\bPhotographer", "arts-media"), (r"\bDancer", "arts-media"), (r"\bAthlete", "arts-media"), (r"\bCoach\b", "arts-media"),
    (r"\bMedia\b", "arts-media"), (r"\bFilm\b", "arts-media"), (r"\bBroadcast", "arts-media"), (r"\bPublic Relations\b", "arts-media"),
    (r"\bPolice\b", "protective-service"), (r"\bFirefighter", "protective-service"), (r"\bSecurity\b", "protective-service"),
    (r"\bCorrection", "protective-service"), (r"\bDetective", "protective-service"), (r"\bGuard\b", "protective-service"),
    (r"\bEMT\b", "protective-service"), (r"\bParamedic", "protective-service"), (r"\bDispatche", "protective-service"),
    (r"\bJanitor", "building-grounds"), (r"\bCleaner", "building-grounds"), (r"\bMaid", "building-grounds"), (r"\bHousekeep", "building-grounds"),
    (r"\bLandscap", "building-grounds"), (r"\bGroundskeeper", "building-grounds"), (r"\bPest Control\b", "building-grounds"),
    (r"\bHairdresser", "personal-care"), (r"\bBarber", "personal-care"), (r"\bCosmetolog", "personal-care"), (r"\bChildcare\b", "personal-care"),
    (r"\bChild Care\b", "personal-care"), (r"\bNanny", "personal-care"), (r"\bFuneral", "personal-care"), (r"\bAnimal Care", "personal-care"),
    (r"\bManicurist", "personal-care"), (r"\bEsthetician", "personal-care"), (r"\bFarm", "agriculture"), (r"\bAgricultur", "agriculture"),
    (r"\bForest", "agriculture"), (r"\bFisher", "agriculture"), (r"\bLogger", "agriculture"), (r"\bScientist", "science"), (r"\bChemist", "science"),
    (r"\bBiologist", "science"), (r"\bPhysicist", "science"), (r"\bResearcher", "science"), (r"\bResearch\b", "science"),
    (r"\bLaboratory\b", "science"), (r"\bLab\b", "science"), (r"\bStatistician", "science"), (r"\bEconomist", "science"),
    (r"\bPsychologist", "science"), (r"\bSociologist", "science"), (r"\bHistorian", "science"), (r"\bGeographer", "science"),
    (r"\bSocial Work", "social-service"), (r"\bCounselor", "social-service"), (r"\bClergy", "social-service"), (r"\bProbation", "social-service"),
    (r"\bRehabilitation\b", "social-service"), (r"\bCommunity\b", "social-service"),
)

# résumé categories and their functions.
CATEGORIES = {
    "ACCOUNTANT": "finance", "ADVOCATE": "legal", "AGRICULTURE": "agriculture", "APPAREL": "design", "ARTS": "arts-media", "AUTOMOBILE": "skilled-trade",
    "AVIATION": "logistics", "BANKING": "finance", "BPO": "support", "BUSINESS-DEVELOPMENT": "sales", "CHEF": "food-service", "CONSTRUCTION": "skilled-trade",
    "CONSULTANT": "ops", "DESIGNER": "design", "DIGITAL-MEDIA": "arts-media", "ENGINEERING": "technology", "FINANCE": "finance", "FITNESS": "personal-care",
    "HEALTHCARE": "healthcare", "HR": "administrative", "INFORMATION-TECHNOLOGY": "technology", "PUBLIC-RELATIONS": "arts-media", "SALES": "sales", "TEACHER": "education",
}


def title_function(title: Column, rules=SIGNAL_RULES, default: str | None = "unmapped") -> Column:
    """The function of the first rule whose pattern the title holds."""
    first = F.coalesce(*[F.when(title.rlike(pattern), function) for pattern, function in rules])
    return F.coalesce(first, F.lit(default))


def titled(df: DataFrame, title: str, out: str = "func", rules=SIGNAL_RULES, default: str | None = "unmapped") -> DataFrame:
    """Adds the function of each title; the rules run once for each distinct title."""
    once = df.select(title).distinct().withColumn(out, title_function(F.col(title), rules, default))
    names = once.select(F.col(title).alias("_title"), out)
    return df.join(names, df[title].eqNullSafe(names["_title"])).drop("_title")


def category_function(category: Column) -> Column:
    """The function of a category; null for others, which are dropped before training."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), category)
