"""Dictionaries as small tables: field specs, chains, labels. Users extend them by adding rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: US fields as (statement, field, ordered tags, period type, unit keywords).
US_FIELDS = [
    ("IS", "total_revenue", ["Revenues", "SalesRevenueNet", "RevenueFromContractWithCustomerExcludingAssessedTax"], "duration", ["usd"]),
    ("IS", "cost_of_revenue", ["CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfProductsSold"], "duration", ["usd"]),
    ("IS", "gross_profit", ["GrossProfit"], "duration", ["usd"]),
    ("IS", "operating_expenses", ["OperatingExpenses", "CostsAndExpenses", "OperatingCostsAndExpenses"], "duration", ["usd"]),
    ("IS", "operating_income", ["OperatingIncomeLoss"], "duration", ["usd"]),
    ("IS", "non_operating_income_expense_net", ["NonoperatingIncomeExpense", "OtherNonoperatingIncomeExpense"], "duration", ["usd"]),
    ("IS", "other_income", ["OtherIncomeExpenseNet", "OtherNonoperatingIncomeExpense"], "duration", ["usd"]),
    (
        "IS", "income_before_income_taxes",
        [
            "IncomeBeforeTax", "IncomeBeforeTaxExpenseBenefit", "IncomeLossFromContinuingOperationsBeforeIncomeTaxes",
            "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
            "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
            "IncomeLossFromContinuingOperationsAfterNoncontrollingInterestBeforeIncomeTaxes",
            "IncomeLossFromContinuingOperationsIncludingNoncontrollingInterestBeforeIncomeTaxesExtraordinaryItems",
        ],
        "duration", ["usd"],
    ),
    ("IS", "provision_for_income_taxes", ["IncomeTaxExpenseBenefit", "ProvisionForIncomeTaxes"], "duration", ["usd"]),
    ("IS", "net_income", ["NetIncomeLoss", "ProfitLoss", "NetIncomeLossAvailableToCommonStockholdersBasic"], "duration", ["usd"]),
    ("IS", "net_income_per_share_basic", ["EarningsPerShareBasic"], "duration", ["usd/shares", "pure"]),
    ("IS", "net_income_per_share_diluted", ["EarningsPerShareDiluted"], "duration", ["usd/shares", "pure"]),
    ("IS", "shares_outstanding_basic", ["WeightedAverageNumberOfSharesOutstandingBasic"], "duration", ["shares"]),
    ("IS", "shares_outstanding_diluted", ["WeightedAverageNumberOfDilutedSharesOutstanding"], "duration", ["shares"]),
    ("BS", "total_assets", ["Assets"], "instant", ["usd"]),
    ("BS", "cash_and_cash_equivalents", ["CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"], "instant", ["usd"]),
    ("BS", "marketable_securities_current", ["MarketableSecuritiesCurrent", "AvailableForSaleSecuritiesCurrent", "ShortTermInvestments"], "instant", ["usd"]),
    (
        "BS", "marketable_securities_noncurrent",
        ["MarketableSecuritiesNoncurrent", "AvailableForSaleSecuritiesNoncurrent", "LongTermMarketableSecurities", "AvailableForSaleDebtSecuritiesNoncurrent"],
        "instant", ["usd"],
    ),
    ("BS", "short_term_investments", ["ShortTermInvestments"], "instant", ["usd"]),
    ("BS", "total_cash_and_short_term_investments", ["CashCashEquivalentsAndShortTermInvestments", "CashAndCashEquivalentsAndMarketableSecurities"], "instant", ["usd"]),
    ("BS", "inventories", ["InventoryNet"], "instant", ["usd"]),
    ("BS", "accounts_receivable", ["AccountsReceivableNetCurrent", "ReceivablesNetCurrent"], "instant", ["usd"]),
    ("BS", "other_current_assets", ["OtherAssetsCurrent"], "instant", ["usd"]),
    ("BS", "total_current_assets", ["AssetsCurrent"], "instant", ["usd"]),
    ("BS", "property_plant_and_equipment_net", ["PropertyPlantAndEquipmentNet"], "instant", ["usd"]),
    ("BS", "goodwill", ["Goodwill"], "instant", ["usd"]),
    ("BS", "intangible_assets", ["IntangibleAssetsNetExcludingGoodwill", "IntangibleAssetsNetIncludingGoodwill"], "instant", ["usd"]),
    ("BS", "other_noncurrent_assets", ["OtherAssetsNoncurrent"], "instant", ["usd"]),
    ("BS", "accounts_payable", ["AccountsPayableCurrent"], "instant", ["usd"]),
    (
        "BS", "debt_current",
        [
            "LongTermDebtCurrent", "CurrentPortionOfLongTermDebt", "CurrentMaturitiesOfLongTermDebt", "CurrentPortionOfLongTermDebtAndCapitalLeaseObligations",
            "LongTermDebtAndCapitalLeaseObligationsCurrent", "DebtCurrent", "ShortTermDebt", "ShortTermBorrowings",
        ],
        "instant", ["usd"],
    ),
    (
        "BS", "debt_noncurrent",
        ["LongTermDebtNoncurrent", "LongTermDebtAndCapitalLeaseObligationsNoncurrent", "NotesPayableNoncurrent", "BondsPayableNoncurrent", "SeniorNotesNoncurrent"],
        "instant", ["usd"],
    ),
    ("BS", "debt_general", ["LongTermDebt", "LongTermDebtAndCapitalLeaseObligations", "NotesPayableLongTerm", "BondsPayable", "SeniorNotes"], "instant", ["usd"]),
    ("BS", "commercial_paper_current", ["CommercialPaper", "CommercialPaperCurrent"], "instant", ["usd"]),
    ("BS", "other_current_liabilities", ["OtherLiabilitiesCurrent"], "instant", ["usd"]),
    ("BS", "total_current_liabilities", ["LiabilitiesCurrent"], "instant", ["usd"]),
    ("BS", "other_noncurrent_liabilities", ["OtherLiabilitiesNoncurrent"], "instant", ["usd"]),
    ("BS", "total_liabilities", ["Liabilities"], "instant", ["usd"]),
    ("BS", "total_shareholders_equity", ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"], "instant", ["usd"]),
    ("BS", "accumulated_other_comprehensive_income_or_loss", ["AccumulatedOtherComprehensiveIncomeLossNetOfTax"], "instant", ["usd"]),
    ("BS", "common_stock", ["CommonStockValue", "CommonStocksIncludingAdditionalPaidInCapital"], "instant", ["usd"]),
    ("BS", "additional_paid_in_capital", ["AdditionalPaidInCapital"], "instant", ["usd"]),
    ("BS", "retained_earnings", ["RetainedEarningsAccumulatedDeficit"], "instant", ["usd"]),
    ("BS", "noncontrolling_interests", ["NoncontrollingInterestInEquity"], "instant", ["usd"]),
    ("BS", "total_liabilities_and_shareholders_equity", ["LiabilitiesAndStockholdersEquity"], "instant", ["usd"]),
    ("CF", "net_income", ["NetIncomeLoss", "ProfitLoss", "IncomeLossFromContinuingOperations"], "duration", ["usd"]),
    ("CF", "net_cash_operating", ["NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"], "duration", ["usd"]),
    ("CF", "net_cash_investing", ["NetCashProvidedByUsedInInvestingActivities", "NetCashProvidedByUsedInInvestingActivitiesContinuingOperations"], "duration", ["usd"]),
    ("CF", "net_cash_financing", ["NetCashProvidedByUsedInFinancingActivities", "NetCashProvidedByUsedInFinancingActivitiesContinuingOperations"], "duration", ["usd"]),
    ("CF", "minority_share", ["NetIncomeLossAttributableToNoncontrollingInterest", "NetIncomeLossAttributableToNonredeemableNoncontrollingInterest"], "duration", ["usd"]),
    (
        "CF", "effect_of_exchange_rates_on_cash",
        [
            "EffectOfExchangeRateOnCashAndCashEquivalents", "EffectOfExchangeRateChangesOnCash", "EffectOfExchangeRateChangesOnCashAndCashEquivalents",
            "EffectOfExchangeRateChangesOnCashCashEquivalents", "EffectOfExchangeRateChangesOnCashCashEquivalentsAndRestrictedCash",
            "EffectOfExchangeRateChangesOnCashCashEquivalentsAndRestrictedCashEquivalents", "EffectOfExchangeRateOnCashCashEquivalentsAndRestrictedCash",
            "EffectOfExchangeRateOnCashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents",
        ],
        "duration", ["usd"],
    ),
    (
        "CF", "net_change_in_cash",
        [
            "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalentsPeriodIncreaseDecreaseIncludingExchangeRateEffect",
            "CashAndCashEquivalentsPeriodIncreaseDecreaseIncludingExchangeRateEffect",
            "CashCashEquivalentsAndRestrictedCashPeriodIncreaseDecreaseIncludingExchangeRateEffect",
        ],
        "duration", ["usd"],
    ),
    ("CF", "cash_end_of_period", ["CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents", "CashAndCashEquivalentsAtCarryingValue"], "instant", ["usd"]),
]
#: Labels under which the exchange effect is looked for where no tag has it.
EXCHANGE_LABELS = ["effect of exchange rate changes on cash", "effect of exchange rate changes on cash cash equivalents", "effect of exchange rate changes on cash cash equivalents and restricted cash"]
#: Japanese fields as chains of choices among tags (statement, field, choices, period type, units).
JP_CHAINS = [
    ("IS", "total_revenue", [["NetSales"], ["OperatingRevenue1"], ["Revenue"]], "duration", ["jpy"]),
    ("IS", "cost_of_revenue", [["CostOfSales"], ["CostOfGoodsSold"]], "duration", ["jpy"]),
    ("IS", "gross_profit", [["GrossProfit"]], "duration", ["jpy"]),
    ("IS", "operating_expenses", [["SellingGeneralAndAdministrativeExpenses", "SellingGeneralAndAdministrativeExpense", "SellingAndAdministrativeExpenses"]], "duration", ["jpy"]),
    ("IS", "operating_income", [["OperatingIncome"]], "duration", ["jpy"]),
    ("IS", "non_operating_income", [["NonOperatingIncome"]], "duration", ["jpy"]),
    ("IS", "non_operating_expenses", [["NonOperatingExpenses"]], "duration", ["jpy"]),
    ("IS", "other_income", [["OtherIncome"], ["OrdinaryIncome"]], "duration", ["jpy"]),
    ("IS", "income_before_income_taxes", [["IncomeBeforeIncomeTaxes"]], "duration", ["jpy"]),
    ("IS", "provision_for_income_taxes", [["IncomeTaxes"], ["IncomeTaxesCurrent"]], "duration", ["jpy"]),
    ("IS", "net_income", [["ProfitLoss"], ["ProfitLossAttributableToOwnersOfParent"]], "duration", ["jpy"]),
    ("IS", "net_income_per_share_basic", [["BasicEarningsPerShare"]], "duration", ["jpy/share", "pure"]),
    ("IS", "net_income_per_share_diluted", [["DilutedEarningsPerShare"]], "duration", ["jpy/share", "pure"]),
    ("IS", "shares_outstanding_basic", [["AverageNumberOfSharesOutstanding"]], "duration", ["shares"]),
    ("IS", "shares_outstanding_diluted", [["AverageNumberOfDilutedSharesOutstanding"]], "duration", ["shares"]),
    ("BS", "total_assets", [["Assets"]], "instant", ["jpy"]),
    ("BS", "cash_and_cash_equivalents", [["CashAndDeposits"], ["CashAndCashEquivalents"]], "instant", ["jpy"]),
    ("BS", "short_term_investments", [["ShortTermInvestmentSecurities"], ["MarketableSecurities"], ["Securities"]], "instant", ["jpy"]),
    (
        "BS", "total_cash_and_short_term_investments",
        [["CashAndDepositsAndShortTermInvestmentSecurities"], ["CashAndCashEquivalentsAndShortTermInvestmentSecurities"], ["CashAndDepositsAndSecurities"], ["CashAndCashEquivalentsAndSecurities"]],
        "instant", ["jpy"],
    ),
    ("BS", "inventories", [["Inventories"]], "instant", ["jpy"]),
    ("BS", "inventories_finished_goods", [["MerchandiseAndFinishedGoods"], ["FinishedGoods"]], "instant", ["jpy"]),
    ("BS", "inventories_work_in_process", [["WorkInProcess"]], "instant", ["jpy"]),
    ("BS", "inventories_raw_materials_and_supplies", [["RawMaterialsAndSupplies"], ["RawMaterials"]], "instant", ["jpy"]),
    (
        "BS", "accounts_receivable",
        [["NotesAndAccountsReceivableTradeAndContractAssets"], ["AccountsReceivableTradeAndContractAssets"], ["NotesAndAccountsReceivableTrade"], ["AccountsReceivableTrade"]],
        "instant", ["jpy"],
    ),
    ("BS", "other_current_assets", [["OtherCurrentAssets"]], "instant", ["jpy"]),
    ("BS", "total_current_assets", [["CurrentAssets"]], "instant", ["jpy"]),
    ("BS", "total_noncurrent_assets", [["NoncurrentAssets"], ["FixedAssets"]], "instant", ["jpy"]),
    ("BS", "property_plant_and_equipment_net", [["PropertyPlantAndEquipment"]], "instant", ["jpy"]),
    ("BS", "tangible_fixed_assets_total", [["TangibleAssets"], ["PropertyPlantAndEquipment"]], "instant", ["jpy"]),
    ("BS", "goodwill", [["Goodwill"]], "instant", ["jpy"]),
    ("BS", "intangible_assets", [["IntangibleAssets"]], "instant", ["jpy"]),
    ("BS", "investments_and_other_assets_total", [["InvestmentsAndOtherAssets"], ["InvestmentsOtherAssets"]], "instant", ["jpy"]),
    ("BS", "other_noncurrent_assets", [["OtherNonCurrentAssets"]], "instant", ["jpy"]),
    ("BS", "accounts_payable", [["NotesAndAccountsPayableTrade"], ["AccountsPayableTrade"]], "instant", ["jpy"]),
    ("BS", "short_term_debt", [["ShortTermBorrowings"], ["CurrentPortionOfLongTermLoansPayable"]], "instant", ["jpy"]),
    ("BS", "other_current_liabilities", [["OtherCurrentLiabilities"]], "instant", ["jpy"]),
    ("BS", "total_current_liabilities", [["CurrentLiabilities"]], "instant", ["jpy"]),
    ("BS", "total_noncurrent_liabilities", [["NoncurrentLiabilities"], ["FixedLiabilities"]], "instant", ["jpy"]),
    ("BS", "long_term_debt", [["LongTermBorrowings"], ["LongTermLoansPayable"]], "instant", ["jpy"]),
    ("BS", "other_noncurrent_liabilities", [["OtherNonCurrentLiabilities"]], "instant", ["jpy"]),
    ("BS", "total_liabilities", [["Liabilities"]], "instant", ["jpy"]),
    ("BS", "total_net_assets", [["NetAssets"]], "instant", ["jpy"]),
    ("BS", "total_shareholders_equity", [["ShareholdersEquity"], ["Equity"]], "instant", ["jpy"]),
    ("BS", "accumulated_other_comprehensive_income_or_loss", [["AccumulatedOtherComprehensiveIncome"]], "instant", ["jpy"]),
    ("BS", "share_subscription_rights", [["SubscriptionRightsToShares"], ["ShareSubscriptionRights"]], "instant", ["jpy"]),
    ("BS", "common_stock", [["CapitalStock"]], "instant", ["jpy"]),
    ("BS", "additional_paid_in_capital", [["CapitalSurplus"]], "instant", ["jpy"]),
    ("BS", "retained_earnings", [["RetainedEarnings"]], "instant", ["jpy"]),
    ("BS", "noncontrolling_interests", [["NonControllingInterests"]], "instant", ["jpy"]),
    ("BS", "total_liabilities_and_shareholders_equity", [["LiabilitiesAndNetAssets"], ["LiabilitiesAndEquity"]], "instant", ["jpy"]),
    ("CF", "net_cash_operating", [["NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesIFRS"]], "duration", ["jpy"]),
    ("CF", "net_cash_investing", [["NetCashProvidedByUsedInInvestingActivities", "NetCashProvidedByUsedInInvestingActivitiesIFRS"]], "duration", ["jpy"]),
    ("CF", "net_cash_financing", [["NetCashProvidedByUsedInFinancingActivities", "NetCashProvidedByUsedInFinancingActivitiesIFRS"]], "duration", ["jpy"]),
    ("CF", "effect_of_exchange_rates_on_cash", [["EffectOfExchangeRateChangeOnCashAndCashEquivalents", "EffectOfExchangeRateChangesOnCashAndCashEquivalentsIFRS"]], "duration", ["jpy"]),
    ("CF", "net_change_in_cash", [["NetIncreaseDecreaseInCashAndCashEquivalents", "NetIncreaseDecreaseInCashAndCashEquivalentsIFRS"]], "duration", ["jpy"]),
    ("CF", "cash_beginning_of_period", [["CashAndCashEquivalentsAtBeginningOfPeriod"]], "duration", ["jpy"]),
    ("CF", "cash_end_of_period", [["CashAndCashEquivalentsAtEndOfPeriod"]], "duration", ["jpy"]),
    ("CF", "cash_at_date", [["CashAndCashEquivalents", "CashAndCashEquivalentsIFRS"]], "instant", ["jpy"]),
]
#: The fields that reviewers check, by statement.
CHECKED_FIELDS = {
    "IS": ["total_revenue", "operating_income", "income_before_income_taxes", "net_income", "net_income_per_share_basic"],
    "BS": ["total_assets", "cash_and_cash_equivalents", "accounts_receivable", "inventories", "total_liabilities", "total_shareholders_equity", "total_liabilities_and_shareholders_equity"],
    "CF": ["net_income", "net_cash_operating", "net_cash_investing", "net_cash_financing", "net_change_in_cash", "cash_end_of_period"],
}
FIELDS_TYPE = "stmt string, field string, tags array<string>, period_type string, unit_keywords array<string>"


def fields(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or US_FIELDS, FIELDS_TYPE)


def chain_specs(spark: SparkSession, rows=None) -> tuple[DataFrame, DataFrame]:
    """Chains as field specs of their choices and the order of these (field, chain_pos, source), for chain_values; fields are
    named by statement and name."""
    flat = [(stmt, f"{stmt}_{field}#{i}", tags, period, units, f"{stmt}_{field}", i) for stmt, field, choices, period, units in rows or JP_CHAINS for i, tags in enumerate(choices)]
    return fields(spark, [r[:5] for r in flat]), spark.createDataFrame([(r[5], r[6], r[1]) for r in flat], "field string, chain_pos int, source string")
