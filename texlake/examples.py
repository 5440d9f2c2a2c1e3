"""Small inputs and the results that the functions must give, by function.

Shown as queries over a literal table; their SQL is the table of results.
"""

EXAMPLES: dict[str, list[tuple[str, str]]] = {
    "canonicalize": [
        ("x≤5", "$x\\leq5$"),
        ("3×4×5=60", "$3\\times4\\times5$=60"),
        ("2πr", "$2\\pi r$"),
        ("fλ", "$f\\lambda$"),
        ("ε₀", "$\\epsilon_{0}$"),
        ("n→∞", "$n\\rightarrow\\infty$"),
        ("kΩ", "k$\\Omega$"),
        ("µs", "$\\mu$s"),
        ("2√3", "2$\\sqrt{3}$"),
        ("α β", "$\\alpha$ $\\beta$"),
        ("e^{iπ}", "$e^{i\\pi}$"),
        ("x_{α}", "$x_{\\alpha}$"),
        ("\\frac{π}{2}", "$\\frac{\\pi}{2}$"),
        ("\\$1.56 \\text{ m}$", "$1.56 \\text{ m}$"),
        ("Solve $ x^2 + 1 = 0 $ now", "Solve $x^2 + 1 = 0$ now"),
        ("$\\frac{1}{2$", "$\\frac{1}{2}$"),
        ("$x^{2$", "$x^{2}$"),
        ("$x}$", "${x}$"),
        ("${{x}}$", "${x}$"),
        ("$d = 2\\,\\AA$", "$d = 2\\,\\text{Å}$"),
        ("What is $x + 1 equal to?", "What is x + 1 equal to?"),
        ("Water H_2O and x_0", "Water $H_2O$ and $x_0$"),
        ("MCQ_SINGLE and lo_0", "MCQ_SINGLE and lo_0"),
        ("$q_001_easy_2026$", "$q_001_easy_2026$"),
        ("\\sqrt{2}3", "$\\sqrt{2}3$"),
        ("use \\sqrt here", "use \\sqrt here"),
        ("https://a.example/b_c.png", "https://a.example/b_c.png"),
        ("see https://a.example/b_c.png", "see https://a.example/b_c.png"),
    ],
    "fix": [
        ("H₂O", "$\\text{H}_{2}\\text{O}$"),
        ("SO₄²⁻", "$\\text{SO}_{4}^{2-}$"),
        ("Fe³⁺", "$\\text{Fe}^{3+}$"),
        ("2H₂O", "$\\text{2H}_{2}\\text{O}$"),
        ("Water (H₂O)", "Water ($\\text{H}_{2}\\text{O}$)"),
        ("H2O", "H2O"),
        ("10⁻³", "$10^{-3}$"),
        ("mc²", "$mc^{2}$"),
        ("x₁", "$x_{1}$"),
        ("per mm³", "per $\\text{mm}^{3}$"),
        ("m/s²", "m/$\\text{s}^{2}$"),
        ("x\\leq5", "$x\\leq5$"),
        ("\\pi2", "$\\pi2$"),
        ("$\\times$ $10^8$", "$\\times 10^8$"),
        ("$\\forall$ $\\flat$ $\\bf x$", "$\\forall \\flat$ $\\bf x$"),
        ("leukocytes$\\ldots$", "leukocytes…"),
        ("5 $\\textmu$m", "5 $\\mu$m"),
        ("wait$ \\ldots $now", "wait … now"),
        ("costs $5.", "costs \\$5."),
        ("$50%$", "$50\\%$"),
    ],
    "normalize_option_text": [
        ("$\\text{Coulomb}$", "Coulomb"),
        ("$Coulomb$", "Coulomb"),
        ("$x$", "$x$"),
        ("$\\text{NaCl}$", "$\\text{NaCl}$"),
        ("$\\text{H_{2}O}$", "$\\text{H}_{2}\\text{O}$"),
        ("$50 \\text{ %}$", "$50 \\%$"),
        ("$5 \\text{ \\Omega}$", "$5 \\Omega$"),
        ("\\{A, B\\}", "{A, B}"),
    ],
    "to_plain_text": [
        ("$\\frac{22}{7}$", "22/7"),
        ("$\\frac{a+b}{c+d}$", "(a+b)/(c+d)"),
        ("$2\\frac{1}{2}$", "2(1/2)"),
        ("$\\frac{-1}{4}$", "-1/4"),
        ("$\\binom{n}{k}$", "C(n, k)"),
        ("$\\sqrt[3]{8}$", "³√8"),
        ("$10^{-15}$", "10⁻¹⁵"),
        ("Rs $5 and $x^2$", "Rs $5 and x²"),
        ("A = {1, 2, 3}", "A = {1, 2, 3}"),
        ("Na_2CO_3", "Na₂CO₃"),
        ("$\\begin{pmatrix}a&b\\\\c&d\\end{pmatrix}$", "[a b; c d]"),
        ("Value of Ï€", "Value of π"),
    ],
    "to_plain_pdf": [("$\\vec{F}$", "F⃗"), ("$\\vec{AB}$", "vec(AB)"), ("$\\frac{1}{2}mv^{2}$", "(1/2)mv²")],
    "to_plain_tts": [
        ("$\\frac{1}{2}$", "1 over 2"),
        ("$x^2$", "x squared"),
        ("\\ce{H2O}", "H 2 O"),
        ("$50^\\circ C$", "50 degrees C"),
        ("E_n", "E sub n"),
        ("$4\\pi$", "4 pi"),
    ],
    "to_plain_compare": [
        ("$\\frac{1}{3}$", "1/3"),
        ("x²", "x^2"),
        ("$90^\\circ$", "90°"),
        ("−3", "-3"),
        ("2 \\times 3 = 6", "2*3=6"),
        ("1½", "1 1/2"),
        ("(A) 2/4", "2/4"),
        ("a: b", "a: b"),
        ("㎝", "cm"),
        ("5&thinsp;m", "5 m"),
    ],
    "escape_latex_for_json": [
        ('{"q": "\\frac{1}{2}"}', '{"q": "\\\\frac{1}{2}"}'),
        ('{"q": "a\\nb"}', '{"q": "a\\nb"}'),
        ('{"q": "$\\nu$"}', '{"q": "$\\\\nu$"}'),
        ('{"q": "\\teacher: x"}', '{"q": "\\\\teacher: x"}'),
    ],
    "normalize": [
        ("$5000 and $\\frac14$", "\\$5000 and $\\frac14$"),
        ("$5-$10", "\\$5-\\$10"),
        ("Solve $ x + 1 = 0 $ for x.", "Solve $x + 1 = 0$ for x."),
        ("a &amp; b", "a & b"),
        ("â‚¬5", "€5"),
        ("One.\\nTwo \\neq three", "One.\nTwo \\neq three"),
    ],
    "ce_to_latex": [
        ("\\ce{H2O}", "{\\mathrm{H}_{2}\\mathrm{O}}"),
        ("\\ce{SO4^2-}", "{\\mathrm{SO}_{4}^{2-}}"),
        ("\\ce{2H2 + O2 -> 2H2O}", "{2\\mathrm{H}_{2} + \\mathrm{O}_{2} \\rightarrow 2\\mathrm{H}_{2}\\mathrm{O}}"),
        ("\\ce{A ->[\\Delta] B}", "{\\mathrm{A} \\xrightarrow{\\Delta} \\mathrm{B}}"),
        ("\\ce{Na+}", "{\\mathrm{Na}^{+}}"),
        ("\\pu{3e8 m/s}", "{3\\times10^{8}\\ \\mathrm{m/s}}"),
        ("\\pu{25 °C}", "{25\\ {}^{\\circ}\\mathrm{C}}"),
        ("\\ce{?}", "\\ce{?}"),
    ],
    "to_markdown_source": [
        ("7/5 * (3) and *note*", "7/5 \ue02a (3) and *note*"),
        ("* item $x$", "* item \\(x\\)"),
        ("about \\$5 and $$y$$", "about $5 and \\[y\\]"),
    ],
    "mask_escaped_dollars": [("a \\$5 $x\\$$ b", "a \ue02b5 $x\\$$ b")],
}
