"""Elements by atomic number."""

#: The symbols of the periodic table in order.
SYMBOLS = (
    "* H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
NUMBERS = {s: i for i, s in enumerate(SYMBOLS) if i}

#: Usual valences, for atoms written without brackets.
VALENCES = {5: (3,), 6: (4,), 7: (3, 5), 8: (2,), 9: (1,), 15: (3, 5), 16: (2, 4, 6), 17: (1,), 35: (1,), 53: (1,)}
#: The first usual valence and the number of outer electrons, for aromaticity.
FIRST_VALENCE = {1: 1, 5: 3, 6: 4, 7: 3, 8: 2, 9: 1, 13: 3, 14: 4, 15: 3, 16: 2, 17: 1, 32: 4, 33: 3, 34: 2, 35: 1, 51: 3, 52: 2, 53: 1}
OUTER_ELECTRONS = {1: 1, 5: 3, 6: 4, 7: 5, 8: 6, 9: 7, 13: 3, 14: 4, 15: 5, 16: 6, 17: 7, 32: 4, 33: 5, 34: 6, 35: 7, 51: 5, 52: 6, 53: 7}
#: Electronegativity on Pauling's scale.
NEGATIVITY = {1: 2.2, 5: 2.04, 6: 2.55, 7: 3.04, 8: 3.44, 9: 3.98, 13: 1.61, 14: 1.9, 15: 2.19, 16: 2.58, 17: 3.16, 33: 2.18, 34: 2.55, 35: 2.96, 52: 2.1, 53: 2.66}
